"""Name search (substring / alias / fuzzy with ranking) and summary lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import contains_ci, fold_case, is_all_digits, strip_ws, type_bonus
from vitrine.operators.ranking import first_per_key, top_k, top_k_per_group

# --- fixed values: fuzzy shortlist size max(10 * k, 50) (must match the reference) ---
FUZZY_MIN_SHORTLIST = 50
FUZZY_SHORTLIST_FACTOR = 10
# --- end fixed values ---


def _order_terms(df: DataFrame, q: Column, key: str) -> list[Column]:
    """exact (normalised name equals the query) desc, type bonus desc, review
    count desc, name length asc, key asc."""
    cols = set(df.columns)
    exact = (F.lower(F.coalesce(F.col(_name_col(df)), F.lit(""))) == q).cast("int")
    bonus = type_bonus("type") if "type" in cols else F.lit(0.0)  # an integer would be taken as a column number
    reviews = (F.coalesce(F.col("review_count").cast("string").try_cast("double"), F.lit(0.0))
               if "review_count" in cols else F.lit(0.0))
    name_len = F.length(F.coalesce(F.col("name").cast("string"), F.lit("None")))
    return [exact.desc(), bonus.desc(), reviews.desc(), name_len.asc(), F.col(key).asc()]


def _name_col(items: DataFrame) -> str:
    return "name_normalized" if "name_normalized" in items.columns else "name"


def _searched(items: DataFrame) -> list[str]:
    """The text columns of the substring stage."""
    alias = next((c for c in ("alias_text_normalized", "alias_text") if c in items.columns), None)
    return list(dict.fromkeys(c for c in ("name", _name_col(items), alias) if c is not None))


def substring_matches(items: DataFrame, q: str, regex: bool = False) -> DataFrame:
    """Rows whose normalised name, name or alias text contains ``q``."""
    mask = F.lit(False)
    for c in _searched(items):
        mask = mask | contains_ci(c, q, regex)
    return items.where(mask)


def name_similarity(text: Column, q: Column) -> Column:
    """1 - edit distance / length of the longer text (JVM-side)."""
    longer = F.greatest(F.length(text), F.length(q), F.lit(1))
    return F.lit(1.0) - F.levenshtein(text, q) / longer


def _shortlist_size(top_k_n: int) -> int:
    return max(top_k_n * FUZZY_SHORTLIST_FACTOR, FUZZY_MIN_SHORTLIST)


def fuzzy_shortlist(items: DataFrame, q: str, top_k_n: int, key: str = "appid") -> DataFrame:
    """Top ``max(10k, 50)`` rows by :func:`name_similarity` of the (normalised)
    name; the similarity only picks the shortlist."""
    text = F.lower(F.coalesce(F.col(_name_col(items)), F.lit("")))
    scored = items.withColumn("fuzzy_ratio", name_similarity(text, F.lit(q)))
    return top_k(scored, [F.col("fuzzy_ratio").desc(), F.col(key).asc()], _shortlist_size(top_k_n), "__fr").drop("__fr")


def _count_reviews(found: DataFrame, reviews: DataFrame | None, key: str) -> DataFrame:
    """Review counts of the found items only (``reviews``: one row per review)."""
    if reviews is None:
        return found
    mine = reviews.select(key).join(found.select(key).distinct(), key, "left_semi")
    counts = mine.groupBy(key).agg(F.count("*").alias("review_count"))
    return found.drop("review_count").join(counts, key, "left")


def find_by_name(items: DataFrame, name: str, top_k_n: int = 5, key: str = "appid",
                 regex: bool = False, stage: str = "auto", reviews: DataFrame | None = None) -> DataFrame:
    """Ranked ``(rank, appid, name, match_stage)`` for a name query.

    Stage 1: substring over name, normalised name and aliases. Stage 2 (fuzzy)
    runs only when stage 1 finds nothing, which one probe that stops at its
    first row decides. ``stage`` may force "substring" or "fuzzy". Items
    without a ``review_count`` can be ranked by ``reviews`` (one row per
    review): only the found items' reviews are counted.
    """
    q = name.strip().lower()
    if not q:
        return items.sparkSession.createDataFrame(
            [], f"rank int, {key} {items.schema[key].dataType.simpleString()}, name string, match_stage string")
    hits = substring_matches(items, q, regex)
    if stage == "auto":
        stage = "fuzzy" if hits.limit(1).isEmpty() else "substring"
    found = hits if stage == "substring" else fuzzy_shortlist(items, q, top_k_n, key).drop("fuzzy_ratio")
    if reviews is not None:
        found = _count_reviews(found.checkpoint(), reviews, key)
    order = _order_terms(found, F.lit(q), key)
    # copies of a key: the best-ranked one stands for it
    ranked = top_k(first_per_key(found, [key], order), order, top_k_n)
    return ranked.select("rank", key, "name", F.lit(stage).alias("match_stage"))


NAME_GRAM = 3
FIRST_NAMES = 4  # names a query scores at least before its threshold is set


def _runs(text: Column, n: int) -> Column:
    """Substrings of ``n`` characters (a shorter text is a run itself)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def _grams(text: Column, sizes: range) -> Column:
    """Distinct substrings of the given sizes."""
    return F.array_distinct(F.concat(*[_runs(text, n) for n in sizes]))


def _containing(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(__q, __text): the distinct texts that contain a query, by an equi-join on
    the query's rarest run of ``NAME_GRAM`` characters."""
    grams = texts.withColumn("__g", F.explode(_grams(F.col("__text"), range(1, NAME_GRAM + 1))))
    runs = asked.withColumn("__g", F.explode(F.when(F.length("__q") < NAME_GRAM, F.array("__q")).otherwise(
        _grams(F.col("__q"), range(NAME_GRAM, NAME_GRAM + 1)))))
    # sizes of the asked runs only; a run no text has rules its query out
    sizes = grams.join(runs.select("__g").distinct(), "__g", "left_semi").groupBy("__g").agg(F.count("*").alias("__n"))
    rarest = runs.join(sizes, "__g", "left").groupBy("__q").agg(
        F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"))
    return grams.join(rarest, "__g").where(F.contains("__text", F.col("__q"))).select("__q", "__text")


def _most_similar(longer: Column, apart: Column, n: int, shared: Column) -> Column:
    """Upper bound of :func:`name_similarity` of texts that differ in length by
    ``apart`` and share ``shared`` runs of ``n`` characters: one edit destroys ``n``
    runs at most."""
    edits = F.greatest(apart, F.ceil((longer - n + 1 - shared) / n), F.lit(0))
    return F.lit(1.0) - edits / F.greatest(longer, F.lit(1))


def _run_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.where(F.length(col) >= n).select(col, F.explode(_runs(F.col(col), n)).alias("__g")).groupBy(col, "__g").agg(
        F.count("*").alias(f"__n{col}"))


def _bounds(asked: DataFrame, names: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(__q, __name, __rows, __ub) of the names that share a run of one of the sizes
    with a query; the bound is the lowest that any of the sizes gives."""
    q_len, n_len = F.length("__q"), F.length("__name")
    runs = [_run_counts(asked, "__q", n).withColumn("__size", F.lit(n)) for n in sizes]
    named = [_run_counts(names, "__name", n).withColumn("__size", F.lit(n)) for n in sizes]
    both = reduce(DataFrame.unionByName, runs).join(reduce(DataFrame.unionByName, named), ["__size", "__g"])
    least = F.least("__n__q", "__n__name")
    shared = both.groupBy("__q", "__name").agg(*[
        F.coalesce(F.sum(F.when(F.col("__size") == n, least)), F.lit(0)).alias(f"__c{n}") for n in sizes])
    bounds = [_most_similar(F.greatest(q_len, n_len), F.abs(q_len - n_len), n, F.col(f"__c{n}")) for n in sizes]
    bound = F.least(*bounds) if len(bounds) > 1 else bounds[0]
    return shared.join(names, "__name").select("__q", "__name", "__rows", bound.alias("__ub"))


def _thresholds(scored: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(__q, __tau): the similarity of the ``size``-th row, -1 with fewer rows."""
    levels = scored.groupBy("__q", "__sim").agg(F.sum("__rows").alias("__rows"))
    so_far = F.sum("__rows").over(Window.partitionBy("__q").orderBy(F.col("__sim").desc()))
    tau = levels.withColumn("__upto", so_far).where(F.col("__upto") >= size).groupBy("__q").agg(
        F.max("__sim").alias("__tau"))
    return asked.join(tau, "__q", "left").select("__q", F.coalesce("__tau", F.lit(-1.0)).alias("__tau"))


def scored_names(asked: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """(__q, __name, __rows, __sim): for every query text the similarities that
    decide its ``size`` most similar rows; ``names`` are distinct, with their number
    of rows.

    An inverted index of runs of characters gives the names that share runs with a
    query, and how many; that and the lengths bound the similarity from above: first by
    runs of ``NAME_GRAM``, then, for the queries that these do not decide, by shorter
    ones down to single characters. A few names of the highest bounds set the threshold
    (the similarity of the ``size``-th row), then the others whose bound reaches it are
    scored, each pair once. A query is done once its threshold beats the bound of all
    names that share no run; without one common character the similarity is zero, so
    such names are never scored. Few pairs are scored where a query's best names fill its
    shortlist; the less similar the ``size``-th row is, the more names can reach it."""
    spark = asked.sparkSession
    scored = spark.createDataFrame([], "__q string, __name string, __rows bigint, __sim double")
    before = None
    for sizes in ((NAME_GRAM,), tuple(range(NAME_GRAM - 1, 0, -1))):
        found = _bounds(asked, names, sizes)
        if before is not None:  # a bound by longer runs still holds
            found = found.join(before.select("__q", "__name", F.col("__ub").alias("__old")), ["__q", "__name"], "left") \
                .withColumn("__ub", F.least("__ub", "__old")).drop("__old")
        before = found = found.checkpoint()
        for first in (True, False):
            left = found.join(scored, ["__q", "__name"], "left_anti").join(_thresholds(scored, asked, size), "__q").where(
                (F.col("__ub") >= F.col("__tau")) & (F.col("__ub") > 0)).drop("__tau")
            if first:  # the highest bounds, until they hold a shortlist
                left = top_k_per_group(left, ["__q"], [F.col("__ub").desc(), F.col("__name").asc()], size, "__r")
                upto = F.sum("__rows").over(Window.partitionBy("__q").orderBy("__r"))
                left = left.withColumn("__held", upto - F.col("__rows")).where(
                    (F.col("__held") < size) | (F.col("__r") <= FIRST_NAMES)).drop("__r", "__held")
            new = left.select("__q", "__name", "__rows", name_similarity(F.col("__name"), F.col("__q")).alias("__sim"))
            scored = scored.union(new.checkpoint())
        if sizes[-1] > 1:
            lengths = names.agg(F.collect_set(F.length("__name"))).scalar()  # distinct lengths only
            q_len = F.length("__q")
            rest = F.array_max(F.transform("__lengths", lambda x: _most_similar(
                F.greatest(q_len, x), F.abs(q_len - x), sizes[-1], F.lit(0))))
            asked = _thresholds(scored, asked, size).withColumn("__lengths", lengths).where(
                F.col("__tau") <= rest).select("__q").checkpoint()
            if asked.isEmpty():
                break
    return scored


def _fuzzy_batch(items: DataFrame, asked: DataFrame, size: int, key: str) -> DataFrame:
    """(__q, item columns): the shortlist of :func:`fuzzy_shortlist` of every query
    text, from distinct names on one side and distinct texts on the other."""
    named = items.withColumn("__name", F.lower(F.coalesce(F.col(_name_col(items)), F.lit(""))))
    names = named.groupBy("__name").agg(F.count("*").alias("__rows")).checkpoint()
    scored = scored_names(asked, names, size)
    # a name's first rows are all that a shortlist can take of it
    rows = top_k_per_group(named, ["__name"], [F.col(key).asc()], size, "__r").drop("__r")
    tau = _thresholds(scored, asked, size)
    best = scored.where(F.col("__sim") > 0).join(tau, "__q").where(F.col("__sim") >= F.col("__tau"))
    near = best.select("__q", "__name", "__sim").join(rows, "__name")
    # too few rows with any similarity: the first rows of the others follow, by key
    short = best.groupBy("__q").agg(F.sum("__rows").alias("__n"))
    lacking = asked.join(short, "__q", "left").where(F.coalesce("__n", F.lit(0)) < size).select("__q")
    first = named.orderBy(F.col(key).asc()).limit(2 * size).agg(F.collect_list(F.struct(*named.columns)).alias("__f"))
    others = lacking.select("__q", F.explode(first.scalar()).alias("__f")).select("__q", "__f.*").join(
        best.select("__q", "__name"), ["__q", "__name"], "left_anti").withColumn("__sim", F.lit(0.0))
    both = near.unionByName(others)
    return top_k_per_group(both, ["__q"], [F.col("__sim").desc(), F.col(key).asc()], size, "__r").drop(
        "__r", "__sim", "__name")


def find_by_name_batch(items: DataFrame, queries: DataFrame, top_k_n: int = 5, key: str = "appid",
                       text_col: str = "text", qid: str = "qid", reviews: DataFrame | None = None) -> DataFrame:
    """:func:`find_by_name` for a table of queries:
    ``(qid, rank, appid, name, match_stage)``; blank queries give no row.

    Everything is worked out once per distinct query text and distinct item text,
    and handed out to items and queries at the end. Stage 1 is an equi-join: a text
    that contains the query also contains the query's rarest run of ``NAME_GRAM``
    characters (a shorter query is a run itself). Stage 2 scores, for the texts that
    are left, only the names that can be in their shortlist (:func:`scored_names`).
    """
    q = queries.select(F.col(qid).alias("__qid"), F.lower(strip_ws(F.col(text_col))).alias("__q")).where(
        F.col("__q") != "").checkpoint()
    asked = q.select("__q").distinct().checkpoint()
    searched = F.array_distinct(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in _searched(items)]))
    texts = items.select(F.explode(searched).alias("__text")).where(F.col("__text") != "").distinct()
    pairs = _containing(texts, asked).checkpoint()
    hits = items.withColumn("__text", F.explode(searched)).join(pairs, "__text").drop("__text").withColumn(
        "match_stage", F.lit("substring"))
    left = asked.join(pairs.select("__q").distinct(), "__q", "left_anti").checkpoint()
    found = hits
    if not left.isEmpty():
        found = hits.unionByName(_fuzzy_batch(items, left, _shortlist_size(top_k_n), key).withColumn(
            "match_stage", F.lit("fuzzy")))
    if reviews is not None:
        found = _count_reviews(found.checkpoint(), reviews, key)
    order = _order_terms(found, F.col("__q"), key)
    best = first_per_key(found, ["__q", key], order)
    ranked = top_k_per_group(best, ["__q"], order, top_k_n).select("__q", "rank", key, "name", "match_stage")
    return q.join(ranked, "__q").select(F.col("__qid").alias(qid), "rank", key, "name", "match_stage")


def find_by_name_simple(items: DataFrame, name: str, top_k_n: int = 5, key: str = "appid") -> DataFrame:
    """Baseline search without aliases or ranking features: substring of the
    lower-cased name, distinct ``(appid, name)`` rows, the first ``top_k_n``
    by key then name. As in the baseline, a blank query matches every
    named row."""
    q = name.strip().lower()
    hits = items.where(contains_ci("name", q) & F.col("name").isNotNull()).select(key, "name").distinct()
    return top_k(hits, [F.col(key).asc(), F.col("name").asc()], top_k_n).select("rank", key, "name")


def first_candidate(matches: DataFrame, key: str = "appid"):
    """The key of the best match (None if there is none), resolved once so that
    a plan built on it holds a literal."""
    row = matches.where(F.col("rank") == 1).select(key).first()
    return None if row is None else row[0]


def summary_lookup(summaries: DataFrame, text: str | None, key: str = "appid",
                   name: str | None = None) -> DataFrame:
    """Summary row for an id, else for the best name match (substring,
    case-insensitive, most reviews used first). Null counts -> 0.

    ``text`` alone serves both stages (digits are tried as an id first).
    With ``name`` given, as the two request parameters, the id stage uses
    ``text`` and the name stage ``name``. Nothing given or nothing found
    gives no row.
    """
    t = (text or "").strip()
    n = t if name is None else name.strip()
    s = summaries
    if t.isdigit():
        by_id = s.where(F.col(key).cast("string") == F.lit(str(int(t))))
    else:
        by_id = s.where(F.lit(False))
    by_name = s.where(contains_ci("name", n.lower())) if n else s.where(F.lit(False))
    n_id = by_id.select(F.count(F.lit(1))).scalar()
    by_name = by_name.withColumn("__n", n_id).where(F.col("__n") == 0).drop("__n")
    both = by_id.withColumn("__src", F.lit(0)).unionByName(by_name.withColumn("__src", F.lit(1)))
    best = top_k(both, [F.col("__src").asc(), F.coalesce("n_reviews_used", F.lit(0)).desc(),
                        F.col(key).asc()], 1)
    return best.select(key, "name", "summary",
                       F.coalesce(F.col("n_reviews_used"), F.lit(0)).cast("bigint").alias("n_reviews_used"),
                       F.coalesce(F.col("n_reviews_total"), F.lit(0)).cast("bigint").alias("n_reviews_total"))


def resolve_prompts(queries: DataFrame, items: DataFrame, text_col: str = "text",
                    qid: str = "qid", key: str = "appid") -> DataFrame:
    """Classify free-text queries: ``error`` (blank), ``appid`` (all digits and
    a known key), ``name`` (case-folded exact name), else ``semantic`` (to be
    encoded and sent to ``search_by_vector``).

    Both lookups are equi-joins against per-key / per-name aggregates (the
    first exact match is the lowest key), so hot names never gather rows.
    """
    q = queries.select(F.col(qid), F.col(text_col).alias("__raw"))
    q = q.withColumn("__t", strip_ws(F.coalesce(F.col("__raw"), F.lit(""))))
    digits = is_all_digits("__t")
    q = q.withColumn("__kk", F.when(digits, F.col("__t").try_cast("bigint"))).checkpoint()  # read in several parts
    # only catalog rows a query can hit are aggregated: semi-joins to the
    # asked ids and names first (a small batch never groups the catalog)
    asked_keys = q.select(F.col("__kk").alias("__k")).where(F.col("__k").isNotNull()).distinct()
    asked_names = q.select(fold_case("__t").alias("__n")).where(F.col("__n") != "").distinct()
    by_key = (items.join(asked_keys, F.col(key) == F.col("__k"), "left_semi")
              .groupBy(F.col(key).alias("__k")).agg(F.min("name").alias("__kname")))
    by_name = (items.where(F.col("name").isNotNull())
               .join(asked_names, fold_case("name") == F.col("__n"), "left_semi")
               .groupBy(fold_case("name").alias("__n"))
               .agg(F.min_by(F.struct(F.col(key), F.col("name")), F.col(key)).alias("__m")))
    # rows without a key (most texts have no id, blanks no name) never meet a
    # join: a null or blank key would send them all to one task
    no_key = [F.lit(None).cast(by_key.schema[c].dataType).alias(c) for c in by_key.columns]
    no_name = [F.lit(None).cast(by_name.schema[c].dataType).alias(c) for c in by_name.columns]
    numbered = q.where(F.col("__kk").isNotNull()).join(by_key, F.col("__kk") == F.col("__k"), "left")
    blank = F.col("__t") == ""
    other = q.where(F.col("__kk").isNull())
    keyed = numbered.unionByName(other.where(~blank).select("*", *no_key))
    named = keyed.join(by_name, fold_case("__t") == F.col("__n"), "left")
    out = named.unionByName(other.where(blank).select("*", *no_key, *no_name))
    mode = (F.when(F.col("__t") == "", "error").when(F.col("__k").isNotNull(), "appid")
            .when(F.col("__m").isNotNull(), "name").otherwise("semantic"))
    center_id = F.when(F.col("__k").isNotNull(), F.col("__k")).otherwise(F.col(f"__m.{key}"))
    center_name = F.when(F.col("__k").isNotNull(), F.col("__kname")).otherwise(F.col("__m.name"))
    return out.select(F.col(qid), F.col("__raw").alias("text"), mode.alias("mode"),
                      center_id.alias("center_appid"), center_name.alias("center_name"))
