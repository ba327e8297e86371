"""Operator 6: quality rules and a hashed n-gram likelihood ratio.

Only DataFrame functions run on the main path: each document is scored by
array functions over its own words, so no row of a text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import stage, without

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 16
#: Bound of the trusted rows that the target model is fitted on.
SAMPLE = 20_000
#: Mean log-likelihood ratio of an n-gram below which a text is dropped.
LEAST = -1.0


def _let(value, body):
    """``body`` of a value that is computed once: a lambda that captured a column
    instead would compute it for each element wherever Spark inlines the column."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(body):
    return F.filter(F.split(F.coalesce(body, F.lit("")), SPACE), lambda w: w != "")


def _hashes(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(words, hashes):
    """Buckets of a text's words, of its pairs of neighbouring words, and of the
    last two characters of each word, a character n-gram that few texts suffice
    to know. Both arguments are computed once (see :func:`_let`)."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.lit(0), F.size(hashes) - 1)), lambda a, b: bucket(F.xxhash64(a, b)))
    return F.concat(F.transform(hashes, bucket), F.slice(pairs, 1, F.greatest(F.lit(0), F.size(hashes) - 1)), F.transform(words, lambda w: bucket(F.xxhash64(F.substring(w, -2, 2), F.lit(2)))))


def _repeated(hashes):
    """The words inside windows of three that occur twice or more. Windows are
    compared by 64-bit hashes; positions are sorted only in the texts that
    repeat one."""
    windows = F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))))

    def twice(s):
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def count(t):
        placed = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(t)) < F.size(t), _let(placed, lambda s: _let(twice(s), covered))).otherwise(0)

    return _let(windows, count)


def ratio_table(docs: DataFrame, trusted: DataFrame, *, text: str = "text", doc_id: str = "doc_id", smoothing: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """One row, one column: the log ratio of every bucket's rate in trusted
    texts and in all texts. All documents count for the raw corpus; for the
    target, trusted ids (a column doc_id) up to about ``sample``, those of the
    smallest hashes, so that they may be broadcast."""
    ids = trusted.select(F.col("doc_id").alias("_ng_trusted")).where("_ng_trusted IS NOT NULL").distinct()
    n = ids.count()
    if n > sample:
        span = 1 << 30
        ids = ids.where(F.pmod(F.xxhash64("_ng_trusted"), F.lit(span)) < int(span * sample / n))
    rows = docs.select(F.col(doc_id).alias("_ng_id"), F.col(text).alias("_ng_text"))
    rows = rows.join(F.broadcast(ids), F.col("_ng_id") == F.col("_ng_trusted"), "left")
    found = _let(_words(F.col("_ng_text")), lambda w: _let(_hashes(w), lambda h: _grams(w, h)))
    grams = rows.select(F.col("_ng_trusted").isNotNull().cast("long").alias("t"), F.explode(found).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "target", "raw"))).alias("rows"), F.sum("target").alias("T"), F.sum("raw").alias("R"))
    a = float(smoothing)
    return stage(table.select(F.expr(f"transform(rows, x -> ln((x.target + {a}D) / (T + {a * BUCKETS}D)) - ln((x.raw + {a}D) / (R + {a * BUCKETS}D)))").alias("ratios")), "quality-ratios")


def quality(docs: DataFrame, trusted: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: float = LEAST, **options) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr (mean log ratio of the words, pairs of words
    and endings) and kept.

    kept is false if base_failed, else whether llr >= ``least``: the same
    threshold for every document, without sampling. Without trusted rows every
    ratio is 0 up to a constant and the base rules decide. Null and empty texts
    have no words, llr 0 and base_failed true. Repeated rows keep a row each;
    added columns replace input columns of their names; an empty table gives an
    empty one.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    ratios = ratio_table(docs, trusted, text=text, doc_id=doc_id, **options)
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in without(docs, added).columns]
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    duplicates = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.withColumn("_ng_ratios", ratios.scalar())

    def mean(grams):
        total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(F.col("_ng_ratios"), g))
        return total / F.greatest(F.lit(1), F.size(grams))

    measures = _let(_words(F.col(text)), lambda w: _let(_hashes(w), lambda h: F.struct(F.size(w).alias("n"), _repeated(h).alias("covered"), _let(_grams(w, h), mean).alias("llr"))))
    rows = rows.withColumn("_ng_measures", measures)
    rows = rows.select(*kept, F.col("_ng_measures.n").cast("long").alias("n_words"),
                       (F.char_length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
                       F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), duplicates.cast("long").alias("n_dup_lines"),
                       F.col("_ng_measures.covered").cast("long").alias("n_repeat_words"), F.col("_ng_measures.llr").alias("llr"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
