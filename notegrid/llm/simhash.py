"""Operator 5: near-duplicates by SimHash and Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm import golay
from notegrid.llm.arrow import added, utf8
from notegrid.llm.common import components, stage

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The three segments of a fingerprint: lowest bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: Buckets of more fingerprints than this are verified by shared neighbours, not by pairs.
PAIR_BUCKET = 32
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the runs of ``width`` words of a lower-cased text, repeats
    included; of the whole sequence if it is shorter. No words: none."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(joined, seed) if words else b""
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())])
    return np.frombuffer(hashes, dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set; none for no hashes."""
    table = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(table[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return int.from_bytes(np.packbits(bits * 2 > len(table)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text: a bit is set if over half the XXH64 of its shingles set it."""
    return majority(shingle_hashes(text, width, seed))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus fp, the fingerprint as a signed long."""
    return added(docs, text, "fp bigint", lambda texts: [pa.array([_signed(fingerprint(t)) for t in texts], pa.int64())], utf8)


def golay_keys(fps: np.ndarray, others: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints: (row, key). A key holds one whole segment and
    Golay indices of the next ``others`` segments. With at most two differing
    bits over three segments, one segment has none, and the others have at most
    two, so their indices meet."""
    fps = fps.astype(np.uint64)
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    decoded = [golay.keys(p) for p in parts]
    rows, found = [], []
    n = np.arange(len(fps))
    for k in range(3):
        row, key = n, parts[k] + (np.uint64(k) << np.uint64(22))
        for j in range(1, others + 1):
            grid = decoded[(k + j) % 3]
            first = np.concatenate([np.ones((len(grid), 1), bool), grid[:, 1:] != grid[:, :-1]], axis=1)[row]
            key = (key[:, None] << np.uint64(12)) | grid[row].astype(np.uint64)
            at, col = np.nonzero(first)
            row, key = row[at], key[at, col]
        rows.append(row)
        found.append(key)
    return np.concatenate(rows), np.concatenate(found)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(fps), 20_000):
            part = fps[start:start + 20_000]
            row, key = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key.view(np.int64))], names=["fp", "key"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links within buckets of at most PAIR_BUCKET fingerprints."""
    for batch in batches:
        left, right = [], []
        for members in batch.column(0).to_pylist():
            fps = np.sort(np.array(members, dtype=np.int64))
            a, b = np.triu_indices(len(fps), 1)
            near = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= MAX_BITS
            left.append(fps[b[near]])
            right.append(fps[a[near]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([cat(left), cat(right)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all
    fingerprints at MAX_BITS or fewer differing bits.

    Fingerprints meet in Golay buckets. A bucket of up to PAIR_BUCKET members
    is verified pair by pair; in a larger one, members that share a word at
    distance 1 (at most 65 do, each pair of them within 2 bits) are linked to
    the smallest of them, so rows grow with the members, not their square.
    """
    keyed = stage(fps.select("fp").mapInArrow(_keyed, "fp long, key long"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(keyed.join(sizes, "key"), "simhash-met")
    lists = met.where(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    out = lists.mapInArrow(_pairs, "a long, b long")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    near = met.where(F.col("n") > PAIR_BUCKET).select("key", "fp", F.explode(flips).alias("flip"))
    near = near.groupBy("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps"))
    near = near.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), "b").where("a <> b")
    return out.unionByName(near).distinct()


def rooted(fps: DataFrame, found: DataFrame, least: str, label: str) -> DataFrame:
    """(fp, root, least) for distinct ``fps`` (fp, and ``least``, a value of its
    rows): the smallest ``least`` of all fps that the links ``found`` connect."""
    roots = components(found, label)
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", least, F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min(least).alias(least))
    return placed.select("fp", "root").join(firsts, "root")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id, of whatever type the ids are, reachable
    over links of at most two differing bits; null ids never name a component,
    so one of null ids only has null. Null and empty texts and texts without
    words have fingerprint zero and link like any other. Repeated rows and
    repeated ids keep a row each. An empty table gives an empty one; other
    columns are not carried.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    thin = stage(fingerprints(slim).drop("text"), "simhash-fps")
    fps = stage(thin.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "simhash-distinct")
    labels = rooted(fps, links(fps), "component_id", "simhash").select(F.col("fp").alias("_ng_fp"), "component_id")
    out = thin.join(labels, F.col("fp") == F.col("_ng_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies: texts whose sets of
    5-word shingles have a Jaccard similarity of 0.8 or more, directly or over others.

    The row with the smallest id stays, nulls last; of rows that repeat that id,
    the one with the smallest digest; of rows equal in every column, one. Rows
    are told apart by a digest of all their columns, never by their ids.

    Candidates come from Golay links of the SimHash over the same shingles and,
    as 64 bits part pairs at 0.8 by ten bits, from MinHash bands; all are
    verified exactly. Null and empty texts and texts without words are copies of
    each other; texts of up to five words are alike only if their words are the
    same. An empty table gives an empty one; columns are those of ``docs``.
    """
    from notegrid.llm import nearcopies

    slim = docs.select(F.col(doc_id).alias("doc_id"), *row_digest(docs), F.col(text).alias("text"))
    rows = stage(nearcopies.sketched(slim, "text").drop("text"), "near-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_ng_d1", "_ng_d2")).alias("least")
    sets = stage(rows.groupBy("fp").agg(least, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "near-sets")
    near = links(sets.select(F.col("bits").alias("fp")).distinct())
    found = nearcopies.links(sets, slim.select("_ng_d1", "_ng_d2", "text"), near)
    keep = rooted(sets.select("fp", "least"), found, "least", "near").select("least._ng_d1", "least._ng_d2").distinct()
    keep = keep.join(rows.select("_ng_d1", "_ng_d2"), ["_ng_d1", "_ng_d2"]).groupBy("_ng_d1", "_ng_d2").agg(F.count("*").alias("_ng_rows"))
    marked = docs.withColumns(dict(zip(("_ng_e1", "_ng_e2"), row_digest(docs))))
    marked = marked.join(keep, (F.col("_ng_e1") == F.col("_ng_d1")) & (F.col("_ng_e2") == F.col("_ng_d2")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = marked.where("_ng_rows = 1").select(*names)
    many = marked.where("_ng_rows > 1").groupBy("_ng_e1", "_ng_e2").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return one.unionByName(many)


def row_digest(docs: DataFrame) -> list:
    """_ng_d1 and _ng_d2: 128 bits that tell rows apart by all their columns."""
    def plain(f):
        c = F.col(f"`{f.name}`")
        return c.cast("string") if isinstance(f.dataType, (T.StringType, T.VariantType)) else F.to_json(c) if isinstance(f.dataType, T.MapType) else c

    cells = [x for f in docs.schema.fields for x in (F.col(f"`{f.name}`").isNull(), plain(f))]
    return [F.xxhash64(F.lit(k), *cells).alias(f"_ng_d{k}") for k in (1, 2)]
