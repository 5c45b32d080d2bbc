"""Text corpora for enrichment, prompts, and caller-supplied batch generation.

No model ships with the library: generation is a caller function run with
``mapInPandas`` (one set-up per task, per-row errors become null), so the
model host is whatever the cluster provides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import (aliases_from_response, clean_aliases, genres_text,
                                    strip_prefixes, truncate)
from vitrine.operators.ranking import first_per_key, top_k, top_k_per_group

# --- fixed values: corpus limits and join separators (must match the reference) ---
REVIEWS_PER_SUMMARY = 80
SUMMARY_MAX_CHARS = 12000
SUMMARY_SEPARATOR = "\n\n"
ALIAS_DESC_MAX = 6000
ALIAS_GENRES_MAX = 500
ALIAS_EXTRA_MAX = 1000
ALIAS_TEXT_SEPARATOR = "; "
# --- end fixed values ---


def popular_targets(items: DataFrame, min_review_count: int, top_n: int, key: str = "appid",
                    count_col: str = "review_count") -> DataFrame:
    """Top ``top_n`` items by review count among those with at least
    ``min_review_count`` (null counts drop)."""
    cand = items.where(F.col(count_col) >= F.lit(min_review_count))
    return top_k(cand, [F.col(count_col).desc(), F.col(key).asc()], top_n, "target_rank")


def english_only(reviews: DataFrame, language: str = "english", col: str = "language") -> DataFrame:
    """Case-insensitive language filter; skipped when the column is absent."""
    if col not in reviews.columns:
        return reviews
    return reviews.where(F.lower(F.col(col)) == F.lit(language))


def pending_targets(targets: DataFrame, done: DataFrame | None, reviews: DataFrame,
                    key: str = "appid") -> DataFrame:
    """Targets not done yet (anti-join) that have reviews (semi-join).

    Targets are chosen *before* the anti-join: finished items keep their
    places and are not back-filled.
    """
    out = targets
    if done is not None:
        out = out.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out.join(reviews.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def summary_corpus(reviews: DataFrame, items: DataFrame, done: DataFrame | None = None,
                   top_n: int = 100, min_review_count: int = 50,
                   per_item: int | None = REVIEWS_PER_SUMMARY, max_chars: int | None = SUMMARY_MAX_CHARS,
                   key: str = "appid", text_col: str = "review_text",
                   votes_col: str = "votes_up", created_col: str = "timestamp_created",
                   id_col: str = "recommendationid") -> DataFrame:
    """One corpus row per pending popular item:
    ``(appid, name, corpus, n_reviews_used, n_reviews_total, n_chars_total,
    truncated)``.

    English reviews with text, best ``per_item`` by votes then recency (nulls
    as 0), joined with blank lines and cut at ``max_chars`` (``None``: all
    reviews, whole texts). ``n_chars_total`` is the length before the cut, and
    ``truncated`` tells whether anything was cut. Each text is cut at
    ``max_chars`` before the shuffle: the joined prefix is the same and no text
    longer than the result crosses the network. Without ``per_item`` an item's texts
    are one row, which Spark limits to 2 GB; with the default limits a row has
    ``per_item`` texts of ``max_chars`` characters at most.
    """
    eng = english_only(reviews)
    targets = popular_targets(items, min_review_count, top_n, key)
    pending = pending_targets(targets, done, eng, key)
    r = (eng.where(F.col(text_col).isNotNull())
         .join(pending.select(key), key, "left_semi")
         .select(key, F.coalesce(F.col(votes_col), F.lit(0)).alias("__v"),
                 F.coalesce(F.col(created_col), F.lit(0)).alias("__c"),
                 F.col(id_col).alias("__id"), F.length(F.col(text_col).cast("string")).alias("__n"),
                 _cut_at(F.col(text_col).cast("string"), max_chars).alias("__t")))
    first = F.struct((-F.col("__v")).alias("a"), (-F.col("__c")).alias("b"), F.col("__id").alias("c"), F.col("__t"))
    if per_item is not None:
        r = top_k_per_group(r, [key], [F.col("__v").desc(), F.col("__c").desc(), F.col("__id").asc()], per_item, "__r")
    grouped = r.groupBy(key).agg(F.array_sort(F.collect_list(first)).alias("__texts"), F.sum("__n").alias("__chars"))
    corpus = _cut_at(F.array_join(F.transform("__texts", lambda s: s["__t"]), SUMMARY_SEPARATOR), max_chars)
    n_chars = F.col("__chars") + (F.size("__texts") - 1) * len(SUMMARY_SEPARATOR)
    # one name and total per item (a lookup map): copies of an item in the
    # catalog never duplicate its corpus row
    names = first_per_key(
        items.select(key, F.col("name").alias("__name"), F.col("review_count").alias("__total")),
        [key], [F.col("__name").asc_nulls_last(), F.col("__total").desc_nulls_last()])
    return (grouped.join(names, key, "left")
            .select(key,
                    F.coalesce(F.col("__name").cast("string"),
                               F.concat(F.lit(f"{key}="), F.col(key).cast("string"))).alias("name"),
                    corpus.alias("corpus"),
                    F.size("__texts").cast("bigint").alias("n_reviews_used"),
                    F.coalesce(F.col("__total").cast("bigint"),
                               F.size("__texts").cast("bigint")).alias("n_reviews_total"),
                    n_chars.cast("bigint").alias("n_chars_total"),
                    (n_chars > F.length(corpus)).alias("truncated")))


def _cut_at(text: Column, limit: int | None) -> Column:
    return text if limit is None else truncate(text, limit)


# ------------------------------------------------------------------ prompts
SUMMARY_SYSTEM = "You summarise player reviews of one product in a neutral tone."
SUMMARY_TEMPLATE = ("Summarise the reviews of {name}: an overview paragraph, a list of pros, "
                    "a list of cons and who would enjoy it.\n\nReviews:\n{corpus}")


def summary_prompt(corpus: DataFrame, system: str = SUMMARY_SYSTEM,
                   template: str = SUMMARY_TEMPLATE, chat: bool = True) -> DataFrame:
    """Add ``prompt``: system + user text, or a plain tagged fallback."""
    user = _fill(template, {"name": F.col("name"), "corpus": F.col("corpus")})
    if chat:
        prompt = F.concat(F.lit("<system>\n" + system + "\n</system>\n<user>\n"), user, F.lit("\n</user>"))
    else:
        prompt = F.concat(F.lit("Instructions: " + system + "\nRequest: "), user, F.lit("\n\nAnswer:"))
    return corpus.withColumn("prompt", prompt)


ALIAS_TEMPLATE = ("Give up to {k} short search aliases players type for this product, as JSON "
                  "{{\"aliases\": [...]}}.\nName: {name}\nDescription: {description}\n"
                  "Genres: {genres}\nExtra: {extra}")


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """``str.format``-like fill of a template with columns (``{{``/``}}`` escape)."""
    import re
    pieces: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        pieces.append(F.lit(template[pos:m.start()]))
        tok = m.group(0)
        if tok == "{{":
            pieces.append(F.lit("{"))
        elif tok == "}}":
            pieces.append(F.lit("}"))
        else:
            pieces.append(F.coalesce(parts[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def alias_prompt(items: DataFrame, k: int = 6, template: str = ALIAS_TEMPLATE,
                 extra: Column | None = None, desc_max: int | None = ALIAS_DESC_MAX,
                 genres_max: int | None = ALIAS_GENRES_MAX, extra_max: int | None = ALIAS_EXTRA_MAX) -> DataFrame:
    """Add ``prompt`` for alias generation, with description, genres text and
    extra context cut at their limits (``None``: whole), and ``truncated``:
    whether any was cut. Blank names are skipped."""
    desc = F.coalesce(F.col("short_description").cast("string"), F.lit("")) \
        if "short_description" in items.columns else F.lit("")
    genres = genres_text("genres") if "genres" in items.columns else F.lit("")
    ex = extra if extra is not None else F.lit("")
    name = F.trim(F.col("name").cast("string"))
    p = _fill(template, {"k": F.lit(str(k)), "name": name,
                         "description": _cut_at(desc, desc_max), "genres": _cut_at(genres, genres_max),
                         "extra": _cut_at(ex, extra_max)})
    cut = F.lit(False)
    for text, limit in ((desc, desc_max), (genres, genres_max), (ex, extra_max)):
        if limit is not None:
            cut = cut | F.coalesce(F.length(text) > limit, F.lit(False))
    return items.where(name.isNotNull() & (name != "")).withColumns({"prompt": p, "truncated": cut})


def alias_result(responses: DataFrame, k: int = 6, response_col: str = "response",
                 name_col: str = "name") -> DataFrame:
    """Alias rows from model responses: parsed list -> cleaned list (at most
    ``max(6, k)``) -> ``alias_text``. Bad responses give an empty list."""
    raw = aliases_from_response(response_col)
    cleaned = clean_aliases(raw, F.col(name_col), max(6, k))
    return (responses.withColumn("aliases", cleaned)
            .withColumn("alias_text", F.array_join("aliases", ALIAS_TEXT_SEPARATOR)))


def clean_response(c: Column | str) -> Column:
    """Response post-processing: strip and drop leading label prefixes."""
    return strip_prefixes(c)


# ------------------------------------------------------------------ generation

def _spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """Model calls are the slow part: their rows are dealt to many tasks (a
    ranked or aggregated frame often has one partition)."""
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def generate(df: DataFrame, make_fn: Callable[[], Callable[[str], str | None]],
             input_col: str = "prompt", output_col: str = "response", tasks: int | None = None) -> DataFrame:
    """Run a caller-supplied text function over ``input_col`` in ``tasks`` tasks
    (by default the cluster's parallelism).

    ``make_fn`` is called once per task (load a model there); the returned
    function maps one input text to an output text. A row whose call raises
    gets null, like a failed summary. Runs as ``mapInPandas``.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(output_col, T.StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            out = []
            for x in pdf[input_col]:
                try:
                    out.append(None if x is None else fn(x))
                except Exception:  # noqa: BLE001 - a failed row is stored as null
                    out.append(None)
            pdf[output_col] = out
            yield pdf
    return _spread(df, tasks).mapInPandas(run, schema)


def generate_distinct(df: DataFrame, make_fn: Callable[[], Callable[[str], str | None]],
                      input_col: str = "text", output_col: str = "rewritten", tasks: int | None = None) -> DataFrame:
    """Generate once per distinct input (memo of repeated inputs), clean the
    response prefixes and join back. Null responses keep the input."""
    distinct = df.select(input_col).where(F.col(input_col).isNotNull()).distinct()
    done = generate(distinct, make_fn, input_col, "__resp", tasks)
    done = done.withColumn(output_col, F.coalesce(clean_response("__resp"), F.col(input_col))).drop("__resp")
    return df.join(done, input_col, "left")


def encode(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]],
           text_col: str = "text", vec_col: str = "vec", tasks: int | None = None, batch: int = 256) -> DataFrame:
    """Text -> unit vector with a caller-supplied batch encoder, ``batch`` texts
    a call, in ``tasks`` tasks (by default the cluster's parallelism)."""
    import numpy as np
    schema = T.StructType(df.schema.fields + [T.StructField(vec_col, T.ArrayType(T.DoubleType()), True)])

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            parts = [np.asarray(enc(texts[a:a + batch]), dtype="float64") for a in range(0, len(texts), batch)]
            mat = np.concatenate(parts) if parts else np.zeros((0, 0))
            if mat.size:
                norms = np.linalg.norm(mat, axis=1, keepdims=True)
                mat = np.where(norms > 0, mat / np.where(norms > 0, norms, 1), 0.0)
            pdf[vec_col] = list(mat)
            yield pdf
    return _spread(df, tasks).mapInPandas(run, schema)


def with_timestamp(df: DataFrame, col: str = "last_updated") -> DataFrame:
    return df.withColumn(col, F.current_timestamp())
