"""Operator 10: benchmark decontamination by edit distance on word windows.

An item within the edit limit has a piece that is, too. Windows as long as a
piece pass a q-gram count (a bound that no window within the limit fails), are
embedded by CGK random walks, which turn edit distance into Hamming distance,
and meet pieces by repeated sampling of coordinates, as often as a stated recall
needs. Where a piece is met, its whole item is verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import blocks, utf8
from notegrid.llm.common import small, stage
from notegrid.llm.simhash import row_digest

#: Edits allowed for each word of an item, and the words below which an item is met by its halves, word for word.
RATE, SHORT = 0.2, 10
#: Words of a piece, at least, where an item has more than one.
PIECE = 24
#: Share of the pieces at their edit limit that the walks are to meet; coordinates in a sample, samples of a walk, walks at most.
RECALL, COORDINATES, SAMPLES, WALKS = 0.999, 2, 6, 96
#: Benchmark text that is held in memory at once; larger benchmarks are searched in blocks, one after the other.
BLOCK = 2 << 20
_LUT = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_FILTER_BITS = 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower-cased runs of ASCII letters, digits and
    non-ASCII bytes) of the texts, and the offset of each text's first word."""
    joined = b"\n".join(texts) + b"\n"
    data = _LUT[np.frombuffer(joined, dtype=np.uint8)]
    inside = data != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    ends = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(starts), np.uint64)
        lengths = ends - starts
        left = np.arange(len(starts))
        k, longest = 0, int(lengths.max())
        while k < longest and len(left) >= 64:  # the k-th byte of all words that have one
            hashes[left] = (hashes[left] ^ data[starts[left] + k]) * _M1
            hashes[left] ^= hashes[left] >> np.uint64(29)
            k += 1
            left = left[lengths[left] > k]
        for w in left.tolist():  # the rest of a few long words
            value = int(hashes[w])
            for byte in data[starts[w] + k:ends[w]].tolist():
                value = ((value ^ byte) * int(_M1)) & 0xFFFFFFFFFFFFFFFF
                value ^= value >> 29
            hashes[w] = value
        hashes *= _M2
        hashes ^= hashes >> np.uint64(31)
    return hashes, offsets


def allowed(n: int) -> int:
    """Edits allowed for an item of n words."""
    return int(RATE * n)


def cuts(n: int) -> list[int]:
    """Bounds of the pieces of an item of n words, each of PIECE to 2 * PIECE - 1 words, or one."""
    pieces = max(1, n // PIECE)
    return [n * k // pieces for k in range(pieces + 1)]


def shared_at_least(n: int, edits: int) -> int:
    """Trigrams that n words share with any window of n words within so many
    edits: an edit touches three at most, one that it pushes out of the window included."""
    return max(1, n - 2 - 3 * edits)


def trigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = words[:-2] * _M1 ^ words[1:-1] * _M2 ^ words[2:] * _M3
        return (mixed * _M2) >> np.uint64(64 - _FILTER_BITS)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ words[k:k + len(out)]) * _M1
            out ^= out >> np.uint64(32)
    return out


def embed(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, walk: int) -> np.ndarray:
    """CGK embedding, (2n, windows), of the windows of n words at ``starts``: at
    each step a window emits its current word and moves on if a random bit of
    (walk, step, word) says so; past its end or its text's it emits 0. A walk of
    n words ends after about 2n steps."""
    at = starts.copy()
    ends = np.minimum(starts + n, stops)
    out = np.zeros((2 * n, len(starts)), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(2 * n):
            current = np.where(at < ends, padded[np.minimum(at, len(words))], np.uint64(0))
            out[j] = current
            coin = (current ^ np.uint64((walk * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _M2
            at += ((coin >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return out


def sample_keys(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, walk: int) -> np.ndarray:
    """(SAMPLES, windows): hashes of COORDINATES random coordinates of each
    window's embedding. A key of padding alone is 0 and meets nothing."""
    embedded = embed(words, starts, stops, n, walk)
    picks = np.random.default_rng((n, walk)).integers(0, 2 * n, (SAMPLES, COORDINATES))
    out = np.zeros((SAMPLES, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(SAMPLES):
            for c in picks[s]:
                out[s] = (out[s] ^ embedded[c]) * _M1
                out[s] ^= out[s] >> np.uint64(32)
            out[s][~embedded[picks[s]].any(axis=0)] = 0
    return out


@cache
def walks(n: int, edits: int, pairs: int = 2000) -> int:
    """Walks after which at least RECALL of pieces of n words meet themselves with
    ``edits`` random edits, counted over simulated pairs with the walks' own
    random bits; WALKS at most."""
    rng = np.random.default_rng((n, edits))
    left = rng.integers(1, 1 << 62, (pairs, n)).astype(np.uint64)
    right = np.zeros((pairs, n), np.uint64)
    for k in range(pairs):
        words = left[k].tolist()
        for _ in range(edits):
            place, new = int(rng.integers(len(words))), int(rng.integers(1, 1 << 62))
            words[place:place + 1] = ([new], [], [new, words[place]])[int(rng.integers(3))]
        words += rng.integers(1, 1 << 62, n).tolist()
        right[k] = words[:n]
    starts = np.arange(pairs, dtype=np.int64) * n
    missed = np.ones(pairs, bool)
    for walk in range(WALKS):
        a, b = (sample_keys(x.ravel(), starts, starts + n, n, walk) for x in (left, right))
        missed &= ~((a == b) & (a != 0)).any(axis=0)
        if missed.mean() <= 1 - RECALL:
            return walk + 1
    return WALKS


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to any part of the
    text and the first end that reaches it (Myers' bit rows)."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << m - 1
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        ph = down | ~(diagonal | up) & mask
        mh = up & diagonal
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        up = mh | ~(diagonal | ph) & mask
        down = ph & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        words, offsets = word_hashes([(t or "").encode() for _, t in rows])
        self.ids, self.words = [], []
        for k, (name, _) in enumerate(rows):
            own = words[offsets[k]:offsets[k + 1]]
            if len(own):
                self.ids.append(name)
                self.words.append(own)
        # pieces of long items: (item, place in it, words)
        self.pieces, self.lengths, edits = [], {}, {}
        for k, own in enumerate(self.words):
            if len(own) >= SHORT:
                bounds = cuts(len(own))
                for a, b in zip(bounds, bounds[1:]):
                    self.lengths.setdefault(b - a, []).append(len(self.pieces))
                    edits[b - a] = max(edits.get(b - a, 0), allowed(len(own)) // (len(bounds) - 1))
                    self.pieces.append((k, a, own[a:b]))
        # of a short item with one edit, one half is left; without, the whole: by words and hash, (item, place in it)
        self.halves: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, own in enumerate(self.words):
            if len(own) < SHORT:
                bounds = [0, len(own) // 2, len(own)] if allowed(len(own)) else [0, len(own)]
                for a, b in zip(bounds, bounds[1:]):
                    self.halves.setdefault(b - a, {}).setdefault(int(runs(own[a:b], b - a)[0]), []).append((k, a))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=np.uint64)  # of each trigram, a bit for each length that has it
        self.need: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by length, for each sample: sorted keys, pieces
        for place, (n, members) in enumerate(self.lengths.items()):
            self.need[n] = shared_at_least(n, edits[n])
            joined = np.concatenate([self.pieces[p][2] for p in members])
            starts = np.arange(len(members), dtype=np.int64) * n
            for p in members:
                self.filter[trigrams(self.pieces[p][2])] |= np.uint64(1 << place % 64)
            self.buckets[n] = []
            for walk in range(walks(n, edits[n])):
                for keys in sample_keys(joined, starts, starts + n, n, walk):
                    order = np.argsort(keys, kind="stable")
                    self.buckets[n].append((keys[order], np.array(members, np.int32)[order]))
        self.lists = [own.tolist() for own in self.words]

    def search(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, stop) for the best place of every item
        found in each text, by word positions."""
        if not len(words) or not self.words:
            return []
        marks = self.filter[trigrams(words)]
        for edge in offsets[1:-1]:  # no window spans two texts
            marks[max(0, edge - 2):edge] = 0
        hot = np.flatnonzero(marks)
        marks = marks[hot]
        found: dict[tuple[int, int], list[int]] = {}
        for n, table in self.halves.items():
            hashes = runs(words, n)
            at = np.flatnonzero(np.isin(hashes, np.fromiter(table, np.uint64, len(table))))
            text = np.searchsorted(offsets, at, side="right") - 1
            one = at + n <= offsets[text + 1]
            for t, p in zip(text[one].tolist(), at[one].tolist()):
                for item, place in table[int(hashes[p])]:
                    found.setdefault((t, item), []).append(max(p - place, int(offsets[t])))
        for place, n in enumerate(self.lengths):
            own = hot[(marks >> np.uint64(place % 64) & np.uint64(1)).astype(bool)]
            near, owner = self._near(own, self.need[n], n, offsets)
            for t, piece, start in self._met(words, near, offsets[owner + 1], n, owner):
                item, inside, _ = self.pieces[piece]
                found.setdefault((t, item), []).append(max(start - inside, int(offsets[t])))
        out = []
        for (text, item), starts in sorted(found.items()):
            best = self._verify(words, int(offsets[text]), int(offsets[text + 1]), item, sorted(set(starts)))
            if best:
                out.append((text, item, *best))
        return out

    @staticmethod
    def _near(own, need, n, offsets):
        """Every start, with its text, whose window of n words holds ``need`` of the marked trigrams."""
        none = np.empty(0, np.int64)
        if len(own) < need:
            return none, none
        first, last = own[:len(own) - need + 1], own[need - 1:]
        text = np.searchsorted(offsets, first, side="right") - 1
        one = (last - first <= n - 3) & (last < offsets[text + 1])
        first, last, text = first[one], last[one], text[one]
        if not len(first):
            return none, none
        low = np.maximum(last - (n - 3), offsets[text])
        spread = first - low + 1
        near = np.unique(np.repeat(low, spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread))
        return near, np.searchsorted(offsets, near, side="right") - 1

    def _met(self, words, near, stops, n, owner):
        """(text, piece, start) of the windows that meet a piece in a sample, each once."""
        buckets, met = self.buckets[n], set()
        for walk in range(len(buckets) // SAMPLES if len(near) else 0):
            for s, keys in enumerate(sample_keys(words, near, stops, n, walk)):
                table, pieces = buckets[walk * SAMPLES + s]
                low = np.searchsorted(table, keys)
                high = np.searchsorted(table, keys, side="right")
                for at in np.flatnonzero((high > low) & (keys != 0)).tolist():
                    met.update((at, piece) for piece in pieces[low[at]:high[at]].tolist())
        for at, piece in met:
            yield int(owner[at]), piece, int(near[at])

    def _verify(self, words, low, high, item, starts):
        """Exact edit distance around the candidate starts."""
        own, n = self.lists[item], len(self.lists[item])
        k = allowed(n)
        spans: list[list[int]] = []
        for s in starts:
            a, b = max(low, s - k), min(high, s + n + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        best = None
        for a, b in spans:
            distance, end = best_match(own, words[a:b].tolist())
            if distance <= k and (best is None or distance < best[0]):
                back, length = best_match(own[::-1], words[a:a + end][::-1].tolist())
                best = (distance, a + end - length - low if back == distance else max(low, a + end - n) - low, a + end - low)
        return best


def item_blocks(benchmark: DataFrame, text: str, item_id: str, block: int) -> Iterator[list]:
    """Distinct items, ids as text, in blocks of about ``block`` bytes: one is on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / block))
    for part in range(parts):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == part).collect()]


def found_in(slim: DataFrame, blocks_: Iterator[list]) -> DataFrame:
    """For rows (own..., text): own, item_id as text, distance, first_word,
    last_word. Each block is broadcast, searched and its rows staged before the
    next one is read, so that one block is held at a time."""
    own = [c for c in slim.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "text")
    names = [*own, "item_id", "distance", "first_word", "last_word"]
    out = None
    for rows in blocks_:
        shared = slim.sparkSession.sparkContext.broadcast(Items(rows))  # of at most one block

        def run(batches, shared=shared):
            items = shared.value
            for part in blocks(batches, "text"):
                found = items.search(*word_hashes(utf8(part.column(part.schema.get_field_index("text")))))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)).take(at) for c in own], pa.array([items.ids[f[1]] for f in found], pa.string()),
                                                  *[pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)]], names=names)

        found = stage(slim.mapInArrow(run, f"{fields}, item_id string, distance int, first_word int, last_word int"), "benchmark-found")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id,
    distance (word edits), first_word, last_word (positions of the best place).

    An item of n words is found if some part of the text is within RATE * n word
    edits: surely below SHORT words, else if its closest piece is met, which
    RECALL of the pieces at their limit are, and more below it. Items of fewer
    than 5 words must occur word for word, those without words are in no text.
    Null and empty texts hold nothing; rows that repeat an id give one row with
    the best place of all; ties go to the first place. Null ids are one
    document. Item ids may be of any type that a cast to text and back keeps.
    Empty tables give an empty one.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = found_in(slim, item_blocks(benchmark, item_text, item_id, block))
    best = F.min(F.struct("distance", "first_word", "last_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", F.col("item_id").cast(dict(benchmark.dtypes)[item_id]).alias("item_id"), "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Rows are told apart
    by a digest of all their columns, so repeated and null ids are as any."""
    slim = docs.select(*row_digest(docs), F.col(text).alias("text"))
    gone = stage(found_in(slim, item_blocks(benchmark, item_text, item_id, block)).select("_ng_d1", "_ng_d2").distinct(), "benchmark-gone")
    marked = docs.withColumns(dict(zip(("_ng_e1", "_ng_e2"), row_digest(docs))))
    kept = marked.join(small(gone), (F.col("_ng_e1") == F.col("_ng_d1")) & (F.col("_ng_e2") == F.col("_ng_d2")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
