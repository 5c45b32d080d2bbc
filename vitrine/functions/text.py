"""String column functions (names, search text, alias lists, JSON responses)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Java's \s is ASCII-only; (?U) widens it to Unicode white space. The
# information separators \x1c-\x1f also count as white space for str.strip().
_WS = r"[\s\x{1c}-\x{1f}]"
_STRIP_WS = rf"(?U)^{_WS}+|{_WS}+$"


def strip_ws(c: Column | str) -> Column:
    """Remove leading/trailing white space of any kind (``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), _STRIP_WS, "")


def normalize_name(c: Column | str) -> Column:
    """Non-alphanumerics to one space, lower case, trimmed (non-Latin names become empty)."""
    return F.trim(F.lower(F.regexp_replace(_c(c), "[^a-zA-Z0-9]+", " ")))


def clean_lower(c: Column | str) -> Column:
    """null -> "", white space stripped, lower case."""
    return F.lower(strip_ws(F.coalesce(_c(c).cast("string"), F.lit(""))))


def fold_case(c: Column | str) -> Column:
    """Full case folding for caseless equality and join keys: \u00df equals SS, a final
    sigma any other, a ligature its letters. Upper case spells these out and lower
    case of that is one form for all. (The Unicode collations do not help: at the
    strength that ignores case they still tell \u00df from ss.)"""
    text = F.col(c) if isinstance(c, str) else c
    # a dotless i has no other form; the steps between keep the case changes apart
    low = F.replace(F.lower(text), F.lit("\u0131"), F.lit("\ue000"))
    up = F.replace(F.upper(low), F.lit("\u1e9e"), F.lit("SS"))
    return F.replace(F.replace(F.lower(up), F.lit("\ue000"), F.lit("\u0131")), F.lit("\u03c2"), F.lit("\u03c3"))


def contains_ci(c: Column | str, query: str, regex: bool = False) -> Column:
    """Case-insensitive substring test of an already lower-cased query.

    ``regex=True`` treats the query as a (Java) regular expression instead of
    a literal. Null text never matches.
    """
    text = F.lower(F.coalesce(_c(c), F.lit("")))
    if regex:
        return F.coalesce(text.rlike(query), F.lit(False))
    return text.contains(F.lit(query))


def is_all_digits(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(r"^[0-9]+$"), F.lit(False))


def truncate(c: Column | str, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c), 1, n)


def split_list(c: Column | str, sep: str = ",") -> Column:
    """Split on ``sep``, strip items, drop empty items."""
    parts = F.split(_c(c), F.lit(sep))
    return F.filter(F.transform(parts, lambda x: strip_ws(x)), lambda x: x != "")


def clean_array(arr: Column | str) -> Column:
    """Strip every element and drop null or empty ones."""
    return F.filter(F.transform(_c(arr), lambda x: strip_ws(x.cast("string"))),
                    lambda x: x.isNotNull() & (x != ""))


def parse_list_text(c: Column | str) -> Column:
    """Parse list-like text such as ``"['Action', 'RPG']"`` into an array.

    Blank or null text gives an empty array.
    """
    s = strip_ws(_c(c))
    inner = F.when(s.startswith("[") & s.endswith("]"),
                   s.substr(F.lit(2), F.length(s) - 2)).otherwise(s)
    parts = F.split(inner, ",")
    items = F.transform(parts, lambda p: F.regexp_replace(
        F.regexp_replace(strip_ws(p), "^'+|'+$", ""), '^"+|"+$', ""))
    return F.coalesce(F.filter(items, lambda x: x != ""),
                      F.array().cast(T.ArrayType(T.StringType())))


def genres_text(arr: Column | str) -> Column:
    """Genres list to ``"a, b"`` text; null list -> ""."""
    return F.coalesce(F.array_join(clean_array(arr), ", "), F.lit(""))


def empty_string_array() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


# --- fixed values: ranking type bonus and alias rules (must match the reference) ---
GAME_TYPE = "game"
DEMOTED_TYPES = ["dlc", "video", "demo", "music", "application"]
ALIAS_BANNED_WORDS = ["award", "awardwinning", "award-winning", "innovative",
                      "masterpiece", "ultimate", "best"]
ALIAS_MAX_LEN = 32
ALIAS_MAX_WORDS = 5
ALIAS_SINGLE_WORD_MAX = 10
# patterns of the alias form and of camel case
ALIAS_DOUBLE_QUOTES = '^"+|"+$'
ALIAS_SINGLE_QUOTES = "^'+|'+$"
ALIAS_TO_SPACE = "[-_/]+"
ALIAS_DROPPED = r"(?U)[^a-z0-9\s+]"
ALIAS_SPACES = r"(?U)\s+"
CAMEL_CASE = "[a-z][A-Z]"
RESPONSE_PREFIXES = ["Output:", "output:", "Transformed:", "Description:"]
# --- end fixed values ---


def type_bonus(c: Column | str) -> Column:
    """+2 for the main item type, -2 for add-on types, 0 otherwise."""
    t = F.lower(F.coalesce(_c(c).cast("string"), F.lit("")))
    return (F.when(t == GAME_TYPE, 2).otherwise(0)
            - F.when(t.isin(DEMOTED_TYPES), 2).otherwise(0))


def alias_normalize(c: Column | str) -> Column:
    """Alias text form: strip, strip quotes, lower, ``-_/`` to space, drop other
    symbols except ``+``, squeeze white space."""
    bare = F.regexp_replace(F.regexp_replace(strip_ws(_c(c)), ALIAS_DOUBLE_QUOTES, ""), ALIAS_SINGLE_QUOTES, "")
    spaced = F.regexp_replace(F.lower(bare), ALIAS_TO_SPACE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, ALIAS_DROPPED, ""), ALIAS_SPACES, " "))


def looks_camel_case(c: Column | str) -> Column:
    return _c(c).rlike(CAMEL_CASE)


def alias_is_unrealistic(raw: Column, norm: Column) -> Column:
    banned = F.lit(False)
    for w in ALIAS_BANNED_WORDS:
        banned = banned | norm.contains(w)
    return ((norm == "")
            | (F.length(norm) > ALIAS_MAX_LEN)
            | (F.size(F.split(norm, " ")) > ALIAS_MAX_WORDS)
            | looks_camel_case(raw)
            | (~norm.contains(" ") & (F.length(norm) >= ALIAS_SINGLE_WORD_MAX))
            | banned)


def clean_aliases(arr: Column | str, original_name: Column | str, max_k: int = 6) -> Column:
    """Clean a raw alias list: skip null/blank, skip the original name (raw or
    normalised), normalise, drop unrealistic ones, order-preserving dedup,
    keep at most ``max_k``."""
    orig = F.lower(strip_ws(F.coalesce(_c(original_name), F.lit(""))))
    # The row's name forms are bound once: a one-element array mapped by a
    # lambda, whose variable the per-alias lambdas read. (Written directly
    # inside those lambdas they would be re-evaluated for every alias.)
    row = F.array(F.struct(orig.alias("o"), alias_normalize(orig).alias("on"), _c(arr).alias("a")))

    def per_row(r: Column) -> Column:
        o, on = r["o"], r["on"]
        pairs = F.transform(r["a"], lambda a: F.struct(
            strip_ws(a.cast("string")).alias("raw"),
            alias_normalize(a.cast("string")).alias("norm")))
        kept = F.filter(pairs, lambda p: (
            p["raw"].isNotNull() & (p["raw"] != "")
            & ~((o != "") & (F.lower(p["raw"]) == o))
            & ~((o != "") & (on == p["norm"]))
            & ~alias_is_unrealistic(p["raw"], p["norm"])))
        return F.array_distinct(F.transform(kept, lambda p: p["norm"]))

    norms = F.transform(row, per_row).getItem(0)
    return F.coalesce(F.slice(norms, 1, max_k), empty_string_array())


ALIAS_RESPONSE_SCHEMA = T.StructType([T.StructField("aliases", T.ArrayType(T.StringType()), True)])


def extract_json_object(c: Column | str, schema: T.StructType) -> Column:
    """Parse the text from the first ``{`` to the last ``}`` (greedy, across
    lines) as JSON; no object or bad JSON -> null."""
    obj = F.regexp_extract(_c(c), r"(?s)(\{.*\})", 1)
    return F.when(obj != "", F.from_json(obj, schema))


def aliases_from_response(c: Column | str) -> Column:
    """The ``aliases`` list of a model response, or an empty list."""
    parsed = extract_json_object(c, ALIAS_RESPONSE_SCHEMA)
    return F.coalesce(parsed.getField("aliases"), empty_string_array())


def strip_prefixes(c: Column | str, prefixes: Sequence[str] = RESPONSE_PREFIXES) -> Column:
    """Strip the text, then remove each prefix in list order when present
    (stripping again after each removal)."""
    s = strip_ws(_c(c))
    for p in prefixes:
        s = F.when(s.startswith(p), strip_ws(s.substr(F.lit(len(p) + 1), F.length(s)))).otherwise(s)
    return s
