"""Operator 9: shard by extendible hashing under a byte limit.

A directory indexed by the leading bits of a document's hash; only buckets
over the limit split on another bit. The directory is a table, never a
driver-side structure.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import running_total, small, stage, without

#: Bits of the hash: 15 hex digits of an MD5 fit in a signed long.
BITS = 60


def _hash(doc_id: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _directory(thin: DataFrame, limit: int, low: int, depth: int) -> DataFrame:
    """leaf (prefix of ``depth`` bits), local depth (null: still too large),
    bytes and documents of its bucket. Buckets of fewer than ``low`` bits are
    known to be too large."""
    leaves = thin.groupBy(F.shiftright("_ng_hash", BITS - depth).alias("leaf")).agg(F.sum("_ng_bytes").alias("b"), F.count("*").alias("n"))
    leaves = stage(leaves, "shard-leaves")
    up = leaves.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    up = up.withColumn("p", F.expr(f"shiftright(leaf, {depth} - d)"))
    fits = stage(up.groupBy("d", "p").agg(F.sum("b").alias("bytes"), F.sum("n").alias("docs")).where(F.col("bytes") <= limit), "shard-fits")
    lowest = fits.agg(F.min("d")).first()[0]
    up = up.where(F.lit(lowest is not None) & (F.col("d") >= F.lit(lowest or 0))).select("leaf", "d", "p")  # no key of many leaves is left
    # sorted, as Spark's guess of the exploded side's size is that of the file it comes from
    found = up.hint("merge").join(fits, ["d", "p"]).groupBy("leaf").agg(F.min(F.struct("d", "bytes", "docs")).alias("s"))
    return stage(leaves.select("leaf").join(found, "leaf", "left").select("leaf", F.col("s.d").alias("local"), F.col("s.bytes").alias("bytes"), F.col("s.docs").alias("docs")), "shard-directory")


def directory(thin: DataFrame, limit: int, extra_bits: int) -> tuple[int, DataFrame]:
    """(bits, table) for rows (_ng_hash, _ng_bytes): for each leading ``bits`` of
    the hash the buckets under it: first hash, local depth (null: one hash over
    the limit), bytes and documents. A leaf has one bucket unless it had to split."""
    total = thin.agg(F.sum("_ng_bytes")).first()[0] or 0
    bits = depth = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + extra_bits)
    low, left, out = 0, thin, None
    while True:
        table = _directory(left, limit, low, depth)
        ended = table if depth == BITS else table.where("local IS NOT NULL")
        ended = ended.select(F.shiftright("leaf", depth - bits).alias("_ng_leaf"), F.shiftleft("leaf", BITS - depth).alias("first"), "local", "bytes", "docs")
        out = ended if out is None else out.unionByName(ended)
        crowded = table.where("local IS NULL").select("leaf")
        if depth == BITS or crowded.isEmpty():
            break
        low, leaf = depth + 1, F.shiftright("_ng_hash", BITS - depth)
        left = left.join(crowded.withColumnRenamed("leaf", "_ng_crowded"), leaf == F.col("_ng_crowded"), "left_semi")
        depth = min(BITS, depth + 8)
    prefix = F.expr(f"shiftright(first, {BITS} - coalesce(local, {BITS}))")
    whole = out.groupBy("_ng_leaf", "local", prefix.alias("prefix")).agg(F.min("first").alias("first"), F.min("bytes").alias("bytes"), F.min("docs").alias("docs"))
    return bits, stage(whole.groupBy("_ng_leaf").agg(F.collect_list(F.struct("first", "local", "bytes", "docs")).alias("_ng_buckets")), "shard-buckets")


def shard(docs: DataFrame, *, limit: int = 1 << 20, text: str = "text", doc_id: str = "doc_id", extra_bits: int = 3,
          measured: bool = False) -> DataFrame:
    """``docs`` plus n_bytes, depth (bits of the bucket), shard_id, shard_bytes
    and shard_docs. No shard holds more than ``limit`` bytes of text unless it
    is one document that alone exceeds it.

    Hashes and sizes alone decide; the rows are then joined once to the
    directory by the leading bits of their hash: broadcast while the directory
    is small, else one shuffle of the rows by those bits. shard_id is the
    bucket's bits ('' at depth 0), as text. Rows that no bit can part (one hash
    over the limit) and documents over the limit go to overflow pages, shard_id
    bits + '+page': in order of size, of up to half the limit in start offsets,
    or of one document over that half. Null or empty text has 0 bytes; null ids
    hash as the empty string; repeated rows share a bucket until it overflows.
    Input columns with the added names are replaced, others are kept whatever
    their names. An empty table gives an empty one.

    ``measured``: ``docs`` already has _ng_hash and _ng_bytes.
    """
    added = ["n_bytes", "depth", "shard_id", "shard_bytes", "shard_docs"]
    rows = docs if measured else docs.withColumn("_ng_hash", _hash(doc_id)).withColumn("_ng_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    names = [F.col(f"`{c}`") for c in without(docs, [*added, "_ng_hash", "_ng_bytes"]).columns]
    thin = stage(rows.select("_ng_hash", "_ng_bytes"), "shard-sizes")
    bits, table = directory(thin.where(F.col("_ng_bytes") <= limit), limit, extra_bits)
    dealt = rows.withColumn("_ng_at", F.shiftright("_ng_hash", BITS - bits)).join(small(table), F.col("_ng_at") == F.col("_ng_leaf"), "left")
    own = F.filter("_ng_buckets", lambda x: F.call_function("shiftright", x["first"], F.lit(BITS) - F.coalesce(x["local"], F.lit(BITS))) == F.call_function("shiftright", F.col("_ng_hash"), F.lit(BITS) - F.coalesce(x["local"], F.lit(BITS))))
    dealt = dealt.withColumn("_ng_own", F.when(F.col("_ng_bytes") <= limit, F.get(own, 0)))
    local = F.col("_ng_own.local")
    name = F.when(local == 0, "").otherwise(F.expr(f"substr(lpad(bin(_ng_hash), {BITS}, '0'), 1, _ng_own.local)"))
    out = dealt.where(local.isNotNull()).select(*names, F.col("_ng_bytes").alias("n_bytes"), local.alias("depth"), name.alias("shard_id"), F.col("_ng_own.bytes").alias("shard_bytes"), F.col("_ng_own.docs").alias("shard_docs"))
    if thin.where(F.col("_ng_bytes") > limit).isEmpty() and table.where(F.exists("_ng_buckets", lambda x: x["local"].isNull())).isEmpty():
        return out
    return out.unionByName(_pages(dealt.where(local.isNull()).select(*names, "_ng_hash", "_ng_bytes"), limit, names))


def _pages(rest: DataFrame, limit: int, names: list) -> DataFrame:
    """Overflow pages of the rows that share all bits of a hash, or exceed the
    limit. Rows of one hash and size are alike to every page, so reruns agree."""
    rest = rest.withColumn("_ng_big", F.col("_ng_bytes") > limit // 2).withColumn("_ng_row", F.monotonically_increasing_id())
    rest = rest.withColumn("_ng_width", F.when(F.col("_ng_big"), F.lit(1)).otherwise(F.col("_ng_bytes")).cast("long"))
    key = ["_ng_hash", "_ng_big"]
    paged = running_total(rest, key, ["_ng_bytes", "_ng_row"], "_ng_width", "_ng_upto", "shard-overflow")
    start = F.col("_ng_upto") - F.col("_ng_width")
    page = F.when(F.col("_ng_big"), start).otherwise((start / max(1, limit // 2)).cast("long"))
    paged = paged.withColumn("_ng_page", page)
    sums = paged.groupBy(*key, "_ng_page").agg(F.sum("_ng_bytes").alias("_ng_sum"), F.count("*").alias("_ng_count"))
    paged = paged.join(sums, [*key, "_ng_page"])
    name = F.concat(F.expr(f"lpad(bin(_ng_hash), {BITS}, '0')"), F.when(F.col("_ng_big"), "+b").otherwise("+"), F.col("_ng_page").cast("string"))
    return paged.select(*names, F.col("_ng_bytes").alias("n_bytes"), F.lit(BITS).alias("depth"), name.alias("shard_id"), F.col("_ng_sum").alias("shard_bytes"), F.col("_ng_count").alias("shard_docs"))


def shard_report(docs: DataFrame, *, limit: int = 1 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the added columns of :func:`shard`, reading the text once."""
    thin = docs.select(F.col(doc_id), _hash(doc_id).alias("_ng_hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_ng_bytes"))
    return shard(stage(thin, "shard-rows"), limit=limit, doc_id=doc_id, measured=True)
