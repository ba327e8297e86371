"""Near copies of whole documents: pairs whose sets of word shingles have a
Jaccard similarity of ALIKE or more, met by SimHash links and MinHash bands and
verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import added, utf8
from notegrid.llm.common import components, small, stage, unstage
from notegrid.llm.simhash import _signed, majority, shingle_hashes

#: Words in a shingle; a pair is alike from a similarity of 4/5 on.
WIDTH = 5
#: A pair at 0.8 meets in one of the bands with probability 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5
#: Buckets of more sets than this are connected by pivots and blocks, not pair by pair.
PAIR_BUCKET = 32
#: Rounds of pivots before the blocks.
PIVOTS = 2
#: Shingles in a block of sets that are compared at once.
BLOCK = 1 << 16
_MASKS, _ODDS = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_ODDS = _ODDS * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of WIDTH words; texts without words share one of their own."""
    return _set(shingle_hashes(text, WIDTH))


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype(np.uint64)) if len(hashes) else np.zeros(1, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys; each hashes its band's number and ROWS minima."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = (key ^ np.minimum.reduceat((every ^ _MASKS[k]) * _ODDS[k], starts)) * _ODDS[0]
                key ^= key >> np.uint64(32)
            out[:, band] = key
    return out


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def sketched(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus fp (a hash of the set of shingles), size (their number),
    bits (the SimHash over them, repeats included) and bands."""
    def make(texts: list[bytes]) -> list[pa.Array]:
        hashes = [shingle_hashes(t, WIDTH) for t in texts]
        sets = [_set(h) for h in hashes]
        places = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
        bands = pa.ListArray.from_arrays(places, pa.array(band_keys(sets).view(np.int64).ravel()))
        return [_names(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array([_signed(majority(h)) for h in hashes], pa.int64()), bands]

    return added(docs, text, "fp bigint, size int, bits bigint, bands array<bigint>", make, utf8)


def with_grams(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus fp and grams, the set of shingles."""
    def make(texts: list[bytes]) -> list[pa.Array]:
        sets = [shingles(t) for t in texts]
        offsets = pa.array(np.cumsum([0, *[len(s) for s in sets]]), pa.int32())
        return [_names(sets), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))]

    return added(docs, text, "fp bigint, grams array<bigint>", make, utf8)


def sieved(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` (_ng_d1) whose digest may be among ``rows`` (_ng_1):
    a bitmap of 16 bits for each digest, of 2^26 at most and so of 8 MiB, is
    broadcast, and few others pass it. It loses none and decides nothing; it only
    keeps the texts that a join would drop out of its shuffle."""
    bits = 1 << min(26, max(15, (16 * rows.count()).bit_length()))
    place = lambda c: F.pmod(F.col(c), F.lit(bits))
    maps = rows.select(place("_ng_1").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_ng_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_ng_map"))
    maps = stage(maps, "near-sieve")
    bit = F.bitmap_bit_position(place("_ng_d1"))
    byte = F.conv(F.hex(F.substring(F.col("_ng_map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place("_ng_d1")) == F.col("_ng_bucket"))
    return both.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*docs.columns)


def grams_of(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, grams) of the sets in ``ids`` (column id), made again from one row
    of ``docs`` for each, by the digest that ``sets`` names."""
    wanted = stage(sets.select("fp", "least._ng_d1", "least._ng_d2").join(ids.select("id").distinct(), F.col("fp") == F.col("id"), "left_semi"), "near-ids")
    rows = wanted.select(F.col("_ng_d1").alias("_ng_1"), F.col("_ng_d2").alias("_ng_2"))
    texts = sieved(docs, rows).join(small(rows), (F.col("_ng_d1") == F.col("_ng_1")) & (F.col("_ng_d2") == F.col("_ng_2")), "left_semi")
    out = stage(with_grams(texts.select("text"), "text").drop("text").dropDuplicates(["fp"]), "near-grams")
    unstage(wanted)
    return out


def alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that have a similarity of 4/5 or more, exactly."""
    pairs = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    held = grams_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), sets, docs)
    left, right = held.toDF("a", "x"), held.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    out = stage(pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "near-links")
    for used in (held, pairs):
        unstage(used)
    return out


def links(sets: DataFrame, docs: DataFrame, bit_links: DataFrame) -> DataFrame:
    """Links (a, b) between distinct sets (columns fp, least, size, bits, bands)
    of ``docs`` that connect whatever alike pairs connect.

    ``bit_links`` are links (a, b) of SimHash bits; sets of linked or equal bits
    are candidates, as are those that meet in a band. Buckets of up to
    PAIR_BUCKET sets give all their pairs. In a larger one some sets are pivots,
    compared with all others; what they leave unconnected is compared in blocks
    (:func:`block_links`), so that a group of near copies costs rows that grow
    with its members, and no pair of unconnected sets that met is left out.
    """
    first = sets.groupBy("bits").agg(F.min("fp").alias("one"))
    same = sets.select("fp", "bits").join(first, "bits").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    ones = bit_links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    keyed = stage(sets.select(F.col("fp").alias("id"), "size", F.explode("bands").alias("key")), "near-keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(keyed.join(counts, "key"), "near-met")
    unstage(keyed)
    lists = met.where(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.collect_list(F.struct("id", "size")).alias("s"))
    near = lambda a, b: 5 * F.least(a["size"], b["size"]) >= 4 * F.greatest(a["size"], b["size"])
    later = F.transform("s", lambda x, i: F.transform(F.filter("s", lambda y, j: (j > i) & near(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"))))
    pairs = lists.select(F.explode(F.flatten(later)).alias("p")).select("p.*")
    found = alike(pairs.unionByName(same).unionByName(ones), sets, docs)

    hot = met.where(F.col("n") > PAIR_BUCKET).select("key", "id", "size")
    if not hot.limit(1).count():
        return found
    for turn in range(PIVOTS):
        left = unconnected(hot, found, f"near-left{turn}")
        choice = F.min(F.struct((F.col("most") if turn else F.lit(False)).alias("m"), F.xxhash64("id", "key").alias("order"), "id", "size", "root")).alias("p")
        pivots = stage(left.groupBy("key").agg(choice).select(F.col("key").alias("at"), F.col("p.id").alias("b"), F.col("p.size").alias("pivot_size"), F.col("p.root").alias("pivot_root")), "near-pivots")
        tried = left.join(small(pivots), F.col("key") == F.col("at")).where("root <> pivot_root AND 5 * least(size, pivot_size) >= 4 * greatest(size, pivot_size)")
        found = stage(found.unionByName(alike(tried.select(F.col("id").alias("a"), "b"), sets, docs)), "near-found")
    return found.unionByName(block_links(unconnected(hot, found, "near-rest"), sets, docs))


def unconnected(hot: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """``hot`` (key, id, size) of the buckets whose sets are not all connected,
    with the root of each and whether it is the bucket's most frequent one."""
    ids = hot.select(F.col("id").alias("own")).distinct()
    inside = found.join(ids, F.col("a") == F.col("own"), "left_semi").join(ids.toDF("other"), F.col("b") == F.col("other"), "left_semi")
    roots = components(inside, label)
    named = stage(hot.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "size", F.coalesce("root", "id").alias("root")), label)
    per = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = per.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("top")).where("roots > 1")
    out = named.join(small(stage(top.select(F.col("key").alias("at"), "top"), f"{label}-top")), F.col("key") == F.col("at"))
    return out.select("key", "id", "size", "root", (F.col("root") == F.col("top")).alias("most"))


def block_links(left: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the sets of a bucket that have different roots: sets outside
    the bucket's most frequent root against all of the bucket, in blocks of about
    BLOCK shingles each. A block pair gives links of a forest, not all pairs."""
    left = stage(left, "near-hot")
    held = grams_of(left.select("id"), sets, docs)
    totals = left.groupBy("key", "most").agg(F.ceil(F.sum("size") / BLOCK).alias("parts"))
    dealt = left.join(totals, ["key", "most"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")))
    lists = dealt.join(held, F.col("id") == F.col("fp")).groupBy("key", "most", "part").agg(F.collect_list(F.struct("id", "root", "grams")).alias("s"))
    lists = stage(lists, "near-blocks")
    one, two = lists.where("NOT most").toDF("key", "m1", "p1", "x"), lists.toDF("key", "m2", "p2", "y")
    both = one.join(two, "key").where("m2 OR p1 <= p2").select("x", "y")
    out = stage(both.mapInArrow(_block_forest, "a long, b long"), "near-links")
    for used in (held, lists, left):
        unstage(used)
    return out


def forest(first: tuple, second: tuple) -> list[tuple[int, int]]:
    """Links between two lists (ids, roots, sets) that join the roots which alike pairs join."""
    up: dict[int, int] = {}

    def root(r: int) -> int:
        while up.setdefault(r, r) != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    ids, roots, own = second
    sizes = np.array([len(s) for s in own])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate(own)
    out = []
    for a, r, grams in zip(*first):
        hits = np.add.reduceat(np.isin(every, grams, assume_unique=False), starts)
        for k in np.flatnonzero(9 * hits >= 4 * (sizes + len(grams))).tolist():
            p, q = root(r), root(roots[k])
            if p != q:
                up[p] = q
                out.append((a, ids[k]))
    return out


def _block_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def side(members: pa.StructArray) -> tuple:
        grams = members.field("grams")
        return members.field("id").to_pylist(), members.field("root").to_pylist(), [np.asarray(g.values) for g in grams]

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            out += forest(side(batch.column(0)[k].values), side(batch.column(1)[k].values))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
