"""Operator 7: language identification by multilingual mixture inference.

Each document is a mixture of learned languages: expectation-maximisation
estimates the proportions from n-gram likelihoods, and languages join the set
only if the likelihood gains more than a penalty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import added, strings
from notegrid.llm.common import without

BUCKETS = 1 << 14
#: Bound of the labelled rows a model is fitted on, for each language.
SAMPLE = 3000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str) -> np.ndarray | None:
    """Hashed letter trigrams of a text, words padded by one space; None: no letter."""
    words = _LETTERS.findall(text.lower())
    if not any(map(str.isalpha, "".join(words))):  # a run of other numerals is no letter
        return None
    units = np.frombuffer(f" {' '.join(words)} ".encode("utf-16-le"), dtype=np.uint16).astype(np.uint32)
    mixed = units[:-2] * np.uint32(0x9E3779B1) ^ units[1:-1] * np.uint32(0x85EBCA77) ^ units[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(18)


class Model:
    """Smoothed n-gram likelihoods of each language."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.2):
        self.names = names
        rates = counts + smoothing
        self.rates = np.ascontiguousarray((rates / rates.sum(axis=1, keepdims=True)).T)

    def predict(self, text: str, penalty: float, rounds: int) -> list[tuple[str, float]]:
        """The chosen languages and their shares, largest first; none for a text without letters."""
        found = grams(text) if self.names else None
        if found is None:
            return []
        counts = np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        counts = counts[used].astype(float)
        return self.mixture(counts, self.rates[used], penalty, rounds)

    def mixture(self, counts: np.ndarray, rates: np.ndarray, penalty: float, rounds: int) -> list[tuple[str, float]]:
        price = penalty * (1.0 + np.log(counts.sum()))
        alone = counts @ np.log(rates)
        chosen = [int(alone.argmax())]
        best, weights = float(alone[chosen[0]]), np.ones(1)
        if len(self.names) > 1:
            every, _, upper = em(counts, rates, rounds)
            if upper - best > price:  # else no larger set can win
                for k in map(int, np.argsort(-every, kind="stable")):
                    if k in chosen:
                        continue
                    trial = [*chosen, k]
                    shares, likelihood, _ = em(counts, rates[:, trial], rounds)
                    if likelihood - best <= price:
                        break
                    chosen, best, weights = trial, likelihood, shares
        return [(self.names[chosen[k]], float(min(1.0, weights[k]))) for k in np.argsort(-weights, kind="stable")]


def em(counts: np.ndarray, rates: np.ndarray, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Mixture proportions, the log-likelihood they reach, and a bound that no
    proportions pass: the likelihood is concave in them, so its tangent at the
    last ones lies above it, and over proportions is largest at one language."""
    total = counts.sum()
    shares = np.full(rates.shape[1], 1.0 / rates.shape[1])
    mixed = rates @ shares
    for _ in range(rounds):
        after = shares * (rates.T @ (counts / mixed)) / total
        moved = np.abs(after - shares).max()
        shares, mixed = after, rates @ after
        if moved < tolerance:
            break
    reached = float(counts @ np.log(mixed))
    return shares, reached, reached + max(0.0, float((rates.T @ (counts / mixed)).max() - total))


def held_out(doc_id: str):
    """Rows that must not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows of each language, those of
    the smallest hashed ids, out of the rows with an id that are not held out.
    The counts kept are a table of BUCKETS numbers for each language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row per language
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((0, BUCKETS)))
    span = 1 << 20
    spot = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(span))
    bound = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(span, int(span * sample / sizes[n]) + 1)))]), F.col(lang))
    chosen = rows.where(spot < bound).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(body or "")
                if found is not None:
                    kept[name] = kept.get(name, 0) + np.bincount(found, minlength=BUCKETS)
        for name, table in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.astype(np.int64).tobytes()], pa.binary())], names=["lang", "counts"])

    counts = np.zeros((len(names), BUCKETS))
    place = {n: i for i, n in enumerate(names)}

    def add(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept[name] = kept.get(name, 0) + np.frombuffer(table, np.int64)
        for name, table in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.tobytes()], pa.binary())], names=["lang", "counts"])

    parts = chosen.mapInArrow(count, "lang string, counts binary").repartition(8, "lang").mapInArrow(add, "lang string, counts binary")
    for name, table in parts.collect():  # a fixed-size table per language
        counts[place[name]] += np.frombuffer(table, np.int64)
    return Model(names, counts)


def identify(docs: DataFrame, model: Model, *, text: str = "text", penalty: float = 4.0, rounds: int = 25) -> DataFrame:
    """``docs`` plus lang_pred, score and languages.

    languages are the chosen set and its shares, largest first; lang_pred is the
    first of them, score its share. ``penalty`` is the log-likelihood, in units
    of 1 + log(number of n-grams), that each further language must gain. Null
    text and text without a letter are 'und' with score 0 and no languages, as
    is everything if no label was learned. Whole texts are read; language,
    source and id are not. Repeated rows and empty tables need nothing; added
    columns replace input columns of their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def make(texts: list[str]) -> list[pa.Array]:
        found = [shared.value.predict(t, penalty, rounds) for t in texts]
        tops = [f[0] if f else (UNDETERMINED, 0.0) for f in found]
        return [pa.array([t[0] for t in tops], pa.string()), pa.array([t[1] for t in tops], pa.float64()), pa.array([[{"lang": n, "share": x} for n, x in f] for f in found], kind)]

    return added(without(docs, ["lang_pred", "score", "languages"]), text, "lang_pred string, score double, languages array<struct<lang: string, share: double>>", make, strings)


def language_id(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row. A null id is not held
    out and not learned from."""
    model = fit(docs, text=text, lang=lang, doc_id=doc_id)
    slim = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return identify(slim, model, **options).drop("text")


def in_known_language(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or has a share below ``least``."""
    model = fit(docs, text=text, lang=lang, doc_id=doc_id)
    slim = docs.withColumnsRenamed({c: f"_ng_in_{c}" for c in docs.columns})
    out = identify(slim, model, text=f"_ng_in_{text}", **options).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return out.select(*[F.col(f"`_ng_in_{c}`").alias(c) for c in docs.columns])
