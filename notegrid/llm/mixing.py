"""Operator 1: mix sources to target weights by weighted fair queueing.

Only DataFrame functions run on the main path. The text is read once, for the
sizes; all that follows is over narrow rows and a table of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegrid.llm.common import matched, partitions, running_total, small, stage, without

WORD = r"[^\x20\x09-\x0D]+"
#: Place of a row in its source's queue: rows that tie in all of it are equal in id and text.
_KEY = ["_ng_hash", "_ng_id", "_ng_size", "_ng_digest"]


def _keyed(docs: DataFrame, seed: int, text: str, source: str, doc_id: str) -> DataFrame:
    """``docs`` with size and shuffle position; all are functions of the row alone."""
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.withColumns({
        "_ng_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_ng_hash": name,
        "_ng_id": F.col(doc_id),
        "_ng_digest": F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))),
        "_ng_source": F.col(source),
    })


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> weight and target. Targets fill like water:
    with sources in order of cap / weight, the level is the largest of
    (budget - caps before) / (weights from here on)."""
    names = Window.orderBy(F.col("_ng_source").asc_nulls_last())
    place = F.row_number().over(names) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", pick).withColumn("_ng_cap", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_ng_cap") / F.col("weight"), F.col("_ng_source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("_ng_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(all_rows)
    out = out.withColumn("_ng_level", (budget - before) / rest)
    level = F.max("_ng_level").over(all_rows)
    target = F.least(F.col("_ng_cap"), level * F.col("weight"))
    return out.withColumn("target", target).select("_ng_source", "source_size", "weight", "target")


def mix_cuts(thin: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: size, target, and for each repeat the first queue
    position that the global truncation rejects (null: none) and how many of the
    rows that tie there it takes."""
    sizes = thin.groupBy("_ng_source").agg(F.sum("_ng_size").alias("source_size"))
    sources = stage(source_targets(sizes, weights, share, cap), "mix-sources")
    budget = sources.agg(F.sum("source_size")).first()[0]
    budget = float(share) * (budget or 0)
    repeats = max(1, -int(-cap // 1))

    place = [*_KEY, "_ng_row"]
    worded = thin.where("_ng_size > 0").select("_ng_source", *place)
    queued = running_total(worded, ["_ng_source"], place, "_ng_size", "_ng_upto", "mix-queue")
    queued = matched(queued, small(sources), ["_ng_source"])
    queued = queued.withColumn("_ng_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    queued = queued.withColumn("_ng_finish", (F.col("_ng_repeat") * F.col("source_size") + F.col("_ng_upto")) / F.col("target"))
    queued = queued.select("_ng_source", *place, "_ng_repeat", "_ng_finish")

    order = ["_ng_finish", *place, "_ng_repeat"]
    dealt = queued.repartitionByRange(partitions(thin.sparkSession), *order)
    dealt = stage(dealt.withColumn("_ng_part", F.spark_partition_id()), "mix-order")
    first = None
    total = 0
    for part, words in dealt.groupBy("_ng_part").agg(F.sum("_ng_size")).orderBy("_ng_part").collect():  # a row per partition
        if total + words > budget:
            upto = F.sum("_ng_size").over(Window.partitionBy("_ng_part").orderBy(*order)) + F.lit(total)
            over = dealt.where(F.col("_ng_part") == part).withColumn("_ng_total", upto).where(F.col("_ng_total") > budget)
            first = over.orderBy(*order).select(*order).first()
            break
        total += words
    if first is None:
        rejected = F.lit(False)
    else:
        bound = F.struct(*[F.lit(v).cast(dealt.schema[c].dataType).alias(c) for c, v in zip(order, first, strict=True)])
        rejected = F.struct(*order) >= bound
    where = F.struct(F.struct(*_KEY).alias("key"), F.col("_ng_row").alias("row"))
    cuts = [F.min(F.when(rejected & (F.col("_ng_repeat") == r), where)).alias(f"_ng_cut{r}") for r in range(repeats)]
    cut = stage(dealt.groupBy("_ng_source").agg(*cuts), "mix-firsts")
    tied = matched(dealt.where("_ng_repeat = 0"), small(cut), ["_ng_source"])
    here = [F.struct(*_KEY) == F.col(f"_ng_cut{r}.key") for r in range(repeats)]
    before = [F.count_if(h & (F.col("_ng_row") < F.col(f"_ng_cut{r}.row"))).alias(f"_ng_left{r}") for r, h in enumerate(here)]
    every = [F.count_if(h).alias(f"_ng_ties{r}") for r, h in enumerate(here)]
    tied = tied.groupBy("_ng_source").agg(*before, *every)
    keys = [F.col(f"_ng_cut{r}.key").alias(f"_ng_cut{r}") for r in range(repeats)]
    cut = matched(cut, tied, ["_ng_source"], "left").select("_ng_source", *keys, *[f"_ng_left{r}" for r in range(repeats)], *[f"_ng_ties{r}" for r in range(repeats)])
    return stage(matched(sources, cut, ["_ng_source"], "left"), "mix-cuts")


def _decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with _ng_copies. Rows that tie at a cut are equal in source, id
    and text; they are numbered, and the first of them are taken."""
    repeats = [c.removeprefix("_ng_cut") for c in cuts.columns if c.startswith("_ng_cut")]
    cuts = cuts.withColumnsRenamed({c: f"_ng_{c}" for c in cuts.columns if not c.startswith("_ng_")})
    joined = matched(rows, small(cuts), ["_ng_source"])
    ties = F.lit(False)
    for r in repeats:
        ties = ties | F.coalesce((F.col(f"_ng_ties{r}") > 1) & (F.struct(*_KEY) == F.col(f"_ng_cut{r}")), F.lit(False))
    if cuts.where(" OR ".join(f"_ng_ties{r} > 1" for r in repeats)).limit(1).count():
        tied = joined.where(ties).withColumn("_ng_one", F.lit(1).cast("long")).withColumn("_ng_at", F.monotonically_increasing_id())
        tied = running_total(tied, ["_ng_source", *_KEY], ["_ng_at"], "_ng_one", "_ng_place", "mix-ties").drop("_ng_one", "_ng_at")
        joined = joined.where(~ties).withColumn("_ng_place", F.lit(1).cast("long")).unionByName(tied)
    else:
        joined = joined.withColumn("_ng_place", F.lit(1).cast("long"))
    copies = F.lit(0)
    for r in repeats:
        cut, key = F.col(f"_ng_cut{r}"), F.struct(*_KEY)
        taken = cut.isNull() | (key < cut) | ((key == cut) & (F.col("_ng_place") <= F.col(f"_ng_left{r}")))
        copies = copies + F.when((F.col("_ng_size") > 0) & taken, 1).otherwise(0)
    return joined.withColumn("_ng_copies", copies)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42,
        text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` plus size, source_size, target, taken and copies (how often the
    mix holds the document).

    Documents of a source queue in the order of a seeded hash of their id, then
    id, size and a digest of the text, the whole queue up to ``cap`` times over;
    a copy finishes at the words queued up to it over its source's target. The
    copies of all sources are sorted by that time over range partitions and cut
    where the words pass ``share`` of all words. A source's copies are a prefix
    of its queue, so a table of one cut per source and repeat decides every row.

    Null text has size 0, as has a text without words; those rows stay, with
    taken 0. Null sources are one source, last in order. A null id queues as the
    empty string, and rows that repeat an id by their texts. Rows equal in
    source, id and text queue one by one like any others; as they are the same
    document, it is their number that the cut decides. An empty table gives an
    empty one. Input columns with the names of the added ones are replaced. Each
    source's taken words differ from its target by about one document.
    """
    added = ["size", "source_size", "target", "taken", "copies"]
    keyed = _keyed(docs, seed, text, source, doc_id)
    thin = stage(keyed.select("_ng_source", *_KEY, F.monotonically_increasing_id().alias("_ng_row")), "mix-sizes")
    joined = _decided(keyed, mix_cuts(thin, weights, share, cap))
    return joined.select(*[F.col(f"`{c}`") for c in without(docs, added).columns], *_measures())


def _measures() -> list:
    return [F.col("_ng_size").alias("size"), F.col("_ng_source_size").alias("source_size"), F.coalesce("_ng_target", F.lit(0.0)).alias("target"),
            (F.col("_ng_size") * F.col("_ng_copies")).alias("taken"), F.col("_ng_copies").alias("copies")]


def mix_report(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42,
               text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: the decisions of
    :func:`mix` alone, for which the text is read once."""
    keyed = _keyed(docs, seed, text, source, doc_id)
    thin = stage(keyed.select("_ng_source", *_KEY, F.monotonically_increasing_id().alias("_ng_row")), "mix-sizes")
    return _decided(thin, mix_cuts(thin, weights, share, cap)).select(F.col("_ng_id").alias(doc_id), *_measures())


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with its columns, each as often as taken."""
    out = mix(docs, **options).where("copies > 0")
    return out.withColumn("_ng_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
