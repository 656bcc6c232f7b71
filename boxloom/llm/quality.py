"""Quality rules (operator 6): base rules, then adaptive fences from mergeable quantile sketches.

The sketch of a metric is a log-bucket histogram: bucket counts per (language, source, metric) add up, so partial
sketches of tasks, files or days merge by summing, and the result does not depend on their order. A quantile read
from it has a relative error of at most GAMMA - 1.

A group's fence lies beyond its tail: the 0.9 quantile and some times its distance from the median (one bucket at least). Most documents have
none of what a rate counts, and then both are 0; so a rate's fence is no lower than a few occurrences in a short document
of the group (its 0.1 quantile of words). A fence is blended with that of the language, and this with that of all
documents, by the number of documents: n of a group count as n, what it inherits as PRIOR.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import same, small_batches, staged, table, text_hash, window3, word_hashes

#: Ratio between the bounds of neighbouring buckets, the smallest value told from zero, documents that a parent's fence counts as.
GAMMA, FLOOR, PRIOR = 1.02, 1e-4, 100
METRICS = {
    # metric: (expression over the base columns, distances from the median beyond the tail, occurrences always allowed, sides)
    "symbols": ("n_symbols / greatest(n_words, 1L)", 6, 3, "high"),
    "dup_lines": ("n_dup_lines / greatest(n_words, 1L)", 6, 3, "high"),
    "repeats": ("n_repeat_words / greatest(n_words, 1L)", 9, 9, "high"),
    "word_len": ("word_chars / greatest(n_words, 1L)", 4, 0, "both"),
}
#: What has a sketch: the metrics, and the number of words.
SKETCHED = {m: e for m, (e, *_) in METRICS.items()} | {"words": "n_words"}
_SYMBOLS = "#*$%&|<>"
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_STRIP = " \t\n\x0b\x0c\r"


def repeat_words(words: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    w = window3(words)
    _, back, counts = np.unique(w, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[back] > 1)
    mark = np.zeros(len(words), bool)
    for k in range(3):
        mark[hit + k] = True
    return int(np.count_nonzero(mark))


def base(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    chars = len(text) - sum(text.count(c) for c in _STRIP)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(_STRIP):
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in _SYMBOLS), dup, repeat_words(words)


def _base_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [base(x.as_py()) for x in b.column(b.num_columns - 1)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)],
            names=[*b.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def _bucket(x):
    """0 for values under FLOOR, else the index of the log bucket."""
    return F.when(x < FLOOR, 0).otherwise(F.floor(F.log(x / FLOOR) / float(np.log(GAMMA))) + 1).cast("int")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the finest sketches, from which coarser ones are summed."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.expr(e).cast("double")).alias("bucket")) for m, e in SKETCHED.items()])
    return stats.where("not base_failed").select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """A row per group: {tag}_n, its documents, and {tag}_hi_METRIC, {tag}_lo_METRIC from its own sketches."""
    part = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    cum = part.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("total") * tenths, F.col("bucket")))
    value = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(FLOOR * F.pow(F.lit(GAMMA), b - F.lit(0.5)))
    out = cum.groupBy(*keys, "metric").agg(F.max("total").alias("n"), *[value(at(t)).alias(f"q{t}") for t in (1, 5, 9)])
    out = out.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.struct("q1", "q5", "q9"))).alias(m) for m in SKETCHED])
    columns = [F.col("n").alias(f"{tag}_n")]
    for m, (_, reach, allowed, sides) in METRICS.items():
        low, mid, high = (F.col(f"{m}.q{t}") for t in (1, 5, 9))
        far = lambda a, b: F.greatest(a - b, F.greatest(a, b) * (GAMMA - 1))  # noqa: E731  what a sketch can tell apart, at least
        columns.append(F.greatest(high + reach * far(high, mid), allowed / F.col("words.q1")).alias(f"{tag}_hi_{m}"))
        if sides == "both":
            columns.append((low - reach * far(mid, low)).alias(f"{tag}_lo_{m}"))
    return out.select(*keys, *columns)


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) that has a document past the base rules: hi_METRIC and, where it has two sides, lo_METRIC."""
    fine = _fences(sketch, ["lang", "source"], "f")
    lang = _fences(sketch, ["lang"], "l").withColumnRenamed("lang", "_lang")
    whole = _fences(sketch.withColumn("_all", F.lit(1)), ["_all"], "w").drop("_all")
    out = fine.join(lang, same(fine["lang"], lang["_lang"])).crossJoin(F.broadcast(whole))  # whole has one row
    blend = lambda n, own, parent: (n * own + PRIOR * parent) / (n + PRIOR)
    names = [c[2:] for c in whole.columns if c != "w_n"]
    return out.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[blend(F.col("f_n"), F.col(f"f_{c}"), blend(F.col("l_n"), F.col(f"l_{c}"), F.col(f"w_{c}"))).alias(c) for c in names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, lang, source, text_hash, the base columns, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their
    own. Words and lines are compared by their characters as they are (words by 64-bit hashes). Equal rows get
    equal results. Other columns of the input are not read.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_hash(), F.col("text").cast("string").alias("text"))
    stats = docs.mapInArrow(_base_rows, f"doc_id long, lang string, source string, text_hash long, {_BASE}")
    stats = staged(stats.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "quality")
    fence = staged(thresholds(sketches(stats)), "fences")
    out = stats.join(fence, same(stats["lang"], fence["_lang"]) & same(stats["source"], fence["_source"]), "left")
    good = ~F.col("base_failed")
    for m, (e, *_, sides) in METRICS.items():
        x = F.expr(e).cast("double")
        good = good & (x <= F.col(f"hi_{m}"))
        if sides == "both":
            good = good & (x >= F.col(f"lo_{m}"))
    return out.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(good, F.lit(False)).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source", "text_hash")


def _sql() -> str:
    """The query in SQL: the base columns from word lists, then the fences from the same log buckets."""
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {FLOOR} * pow({GAMMA}, {b} - 0.5) END"
    rows = " UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{m}' AS metric, CAST({e.replace('1L', '1')} AS DOUBLE) AS x FROM b" for m, e in SKETCHED.items())
    names = [f"hi_{m}" for m in METRICS] + [f"lo_{m}" for m, (*_, sides) in METRICS.items() if sides == "both"]

    def fence(tag: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        q = lambda m, t: f"max(CASE WHEN metric = '{m}' THEN q{t} END)"
        far = lambda a, b: f"greatest({a} - {b}, greatest({a}, {b}) * {GAMMA - 1})"
        hi = [f"greatest({q(m, 9)} + {reach} * {far(q(m, 9), q(m, 5))}, {allowed} / {q('words', 1)}) AS hi_{m}" for m, (_, reach, allowed, _) in METRICS.items()]
        lo = [f"{q(m, 1)} - {reach} * {far(q(m, 5), q(m, 1))} AS lo_{m}" for m, (_, reach, _, sides) in METRICS.items() if sides == "both"]
        at = ", ".join(f"min(CASE WHEN upto * 10 >= total * {t} THEN bucket END) AS b{t}" for t in (1, 5, 9))
        return f"""{tag}c AS (SELECT {by}metric, bucket, sum(count(*)) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY {by}metric) AS total
  FROM k GROUP BY {by}metric, bucket),
{tag}b AS (SELECT {by}metric, max(total) AS n, {at} FROM {tag}c GROUP BY {by}metric),
{tag}q AS (SELECT *, {", ".join(f"{value(f'b{t}')} AS q{t}" for t in (1, 5, 9))} FROM {tag}b),
{tag} AS (SELECT {by}max(n) AS n, {", ".join(hi + lo)} FROM {tag}q {group})"""

    parent = lambda c: f"((g.n * g.{c} + {PRIOR} * a.{c}) / (g.n + {PRIOR}))"
    blend = ", ".join(f"(f.n * f.{c} + {PRIOR} * {parent(c)}) / (f.n + {PRIOR}) AS {c}" for c in names)
    sides = " AND ".join([f"max(CASE WHEN metric = '{m}' THEN x END) <= max(hi_{m})" for m in METRICS] + [f"max(CASE WHEN metric = '{n[3:]}' THEN x END) >= max({n})" for n in names if n.startswith("lo_")])
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
w AS (SELECT r, unnest(range(1, len(l) - 1)) AS i, unnest([l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] FOR i IN range(1, len(l) - 1)]) AS g FROM l WHERE len(l) > 2),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM w) WHERE c > 1),
n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
s AS (SELECT r, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS s FROM d),
e AS (SELECT r, doc_id, lang, source, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN l]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(s) - len(list_distinct(s)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (r) JOIN s USING (r) LEFT JOIN n USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM e),
m AS MATERIALIZED ({rows}),
k AS MATERIALIZED (SELECT *, CASE WHEN x < {FLOOR} THEN 0 ELSE CAST(floor(ln(x / {FLOOR}) / ln({GAMMA})) AS INTEGER) + 1 END AS bucket FROM m WHERE NOT base_failed),
{fence("f", "lang, source")},
{fence("g", "lang")},
{fence("a", "")},
t AS (SELECT f.lang, f.source, {blend} FROM f JOIN g ON g.lang IS NOT DISTINCT FROM f.lang CROSS JOIN a),
v AS (SELECT m.r, {sides} AS good FROM m JOIN t ON t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source GROUP BY m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, false) AS kept FROM b LEFT JOIN v USING (r)
"""


SQL = _sql()
