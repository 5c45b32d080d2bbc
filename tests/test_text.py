"""Column string functions against hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as tx


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_normalize_name(spark):
    assert one(spark, tx.normalize_name("x"), "Half-Life 2: Episode  One!") == "half life 2 episode one"
    assert one(spark, tx.normalize_name("x"), "東方") == ""


def test_clean_lower_unicode_space(spark):
    assert one(spark, tx.clean_lower("x"), "　\tPortal 2  ") == "portal 2"
    assert one(spark, tx.clean_lower("x"), None) == ""


def test_contains_literal_vs_regex(spark):
    df = spark.createDataFrame([("c++ game",), ("cxx game",)], "x string")
    lit = df.where(tx.contains_ci("x", "c++")).count()
    rx = df.where(tx.contains_ci("x", "c.x", regex=True)).count()
    assert (lit, rx) == (1, 1)


def test_digits(spark):
    df = spark.createDataFrame([("620",), ("62a",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.is_all_digits("x")).collect()] == [True, False, False, False]


def test_parse_list_text(spark):
    assert one(spark, tx.parse_list_text("x"), "['Action', \"RPG\",  , 'Indie']") == ["Action", "RPG", "Indie"]
    assert one(spark, tx.parse_list_text("x"), "") == []


def test_genres_text(spark):
    v = one(spark, tx.genres_text("x"), [" Action", None, "", "RPG "], "x array<string>")
    assert v == "Action, RPG"
    assert one(spark, tx.genres_text("x"), None, "x array<string>") == ""


def test_type_bonus(spark):
    df = spark.createDataFrame([("game",), ("DLC",), ("tool",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.type_bonus("x")).collect()] == [2, -2, 0, 0]


def test_strip_prefixes(spark):
    assert one(spark, tx.strip_prefixes("x"), "  Output:  Transformed: a calm farming game ") == \
        "a calm farming game"
    assert one(spark, tx.strip_prefixes("x"), "Transformed: Output: x") == "Output: x"


# ---- alias cleaning: expectations worked out by hand -----------------------------
ALIASES = [
    # name, raw aliases, kept aliases
    ("Moon Harbor", ["  'Moon-Tide'  ", "MOON TIDE", "moon harbor", "Moon/Harbor"], ["moon tide"]),
    ("Moon Harbor", ["seaSide", "Seaside", "lighthouses", "light house"], ["seaside", "light house"]),
    ("Moon Harbor", ["one two three four five", "one two three four five six", "x" * 33 + " y"],
     ["one two three four five"]),
    ("Moon Harbor", ["the best boats", "ultimate", "row+sail", "boat!?", None, "   "], ["row+sail", "boat"]),
    (None, ["m1", "m2", "m3", "m4", "m5", "m6", "m7"], ["m1", "m2", "m3", "m4", "m5", "m6"]),
    ("Moon Harbor", None, []),
]


@pytest.mark.parametrize("name,raw,kept", ALIASES)
def test_clean_aliases(spark, name, raw, kept):
    df = spark.createDataFrame([(raw, name)], "a array<string>, n string")
    assert df.select(tx.clean_aliases("a", "n", 6).alias("r")).first()["r"] == kept


def test_alias_response_parsing(spark):
    rows = [("blah {\"aliases\": [\"a b\", \"c\"]} tail",), ("no json",), ("{\"aliases\": \"x\"}",),
            ("{broken",), ("{\"other\": 1}\n{\"aliases\": [\"z\"]}",)]
    df = spark.createDataFrame(rows, "x string")
    got = [r[0] for r in df.select(tx.aliases_from_response("x")).collect()]
    # greedy first-{ to last-} text; the last row spans two objects -> invalid JSON
    assert got == [["a b", "c"], [], [], [], []]


def test_fold_case_is_full_case_folding(spark):
    from vitrine.functions.text import fold_case
    texts = ["Straße", "STRASSE", "ẞ", "ﬁn", "FIN", "ΟΔΟΣ", "οδος", "οδοσ", "ı", "I", "İ", "ŉ", "ſ", "µ", "ΐ", "K", "Å", "plain", ""]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", fold_case("t").alias("f")).collect()}
    assert got == {t: t.casefold() for t in texts}
    # every character of the first plane, but for scripts whose folding goes to upper case and the letters of Unicode 16
    new = {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC}
    every = [(chr(i),) for i in range(0x20, 0xE000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(every, "t string").select("t", fold_case("t").alias("f")).collect()
    assert all(r.f == r.t.casefold() for r in rows if not (0x13A0 <= ord(r.t) < 0x1400 or 0xAB70 <= ord(r.t) < 0xABC0
                                                        or ord(r.t) in new))
