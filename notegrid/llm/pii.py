"""Operator 8: personal data by bootstrapped contextual extraction.

Seeds are the entities of the base patterns and a share of the long hexadecimal
secrets. The words on either side of an entity, with its shape, are lexical
patterns. Patterns and instances form a bipartite graph that Spark scores in
rounds: a pattern is worth the mean of its instances, an instance what its
patterns lend it. Patterns that end with high confidence mark the candidates
they hold, which no base pattern has seen.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import added, strings
from notegrid.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits matches from its first digit or not at all, so the look-behind
# and the possessive quantifiers change no match and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may be an identifier: a token of 6 or more with a digit or an @, or digits in groups.
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z._%+/-]*[0-9@])[A-Za-z0-9+][A-Za-z0-9._%+/@-]{4,}[A-Za-z0-9]")
_GROUPS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)+(?![A-Za-z0-9])")
_HEX = re.compile(r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]+")
#: A secret has at least so many hexadecimal digits; one in so many distinct ones is a seed.
SECRET, SEED_SHARE = 32, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern. A local part ends at its @, so
    it is the run of its characters before the @, cut by the match before."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def matches(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The base spans (start, end, kind) by start, then kind, and the numbers
    that have the form of a card or an address but fail its check."""
    out, failed = [(a, b, "email") for a, b in emails(text)] if "@" in text else [], []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
            else:
                failed.append(m.span())
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                if luhn(digits):
                    out.append((*m.span(), "card"))
                else:
                    failed.append(m.span())
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))), failed


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    return matches(text)[0]


def shape(value: str) -> str:
    if "@" in value:
        return "address"
    if _HEX.fullmatch(value):
        return "hex"
    if re.fullmatch(r"[0-9]+(\.[0-9]+)+", value):
        return "dotted"
    if re.fullmatch(r"[0-9 ().+-]+", value):
        return "digits"
    return "mixed"


def form(value: str) -> str:
    """Shape and length: what makes an unseen instance resemble the seeds."""
    return f"{shape(value)}:{len(value)}"


def _word_before(text: str, at: int) -> int:
    while at and not text[at - 1].isspace():
        at -= 1
    return at


def left_context(text: str, start: int) -> str:
    """The two words left of an entity and what is glued to it, on its line,
    however long they are. With fewer words, whatever stands left; a line's
    start is a word of its own."""
    at = _word_before(text, start)
    words = [text[at:start]]
    for _ in range(2):
        while at and text[at - 1].isspace() and text[at - 1] != "\n":
            at -= 1
        if not at or text[at - 1] == "\n":
            words.append("^")
            break
        end, at = at, _word_before(text, at)
        words.append(text[at:end])
    return re.sub(r"[0-9]+", "0", " ".join(words[::-1]).lower())


def right_context(text: str, stop: int) -> str:
    """What is glued to an entity's end, and the next word on its line; a line's end is a word of its own."""
    def word_end(at: int) -> int:
        while at < len(text) and not text[at].isspace():
            at += 1
        return at

    glued = at = word_end(stop)
    while at < len(text) and text[at].isspace() and text[at] != "\n":
        at += 1
    word = text[at:word_end(at)] or "$"
    return re.sub(r"[0-9]+", "0", f"{text[stop:glued]} {word}".lower())


def _number(value: str) -> int:
    n = xxhash.xxh64_intdigest(value.encode())
    return n - (1 << 64) if n >> 63 else n


def candidates(text: str) -> list[tuple[int, int, str, str, str, str, str | None]]:
    """(start, end, left pattern, right pattern, instance, form, label) of base
    spans, failed matches and other tokens; numbers inside a longer token are
    part of it. The label is a seed's kind, 'none'
    of a failed match, which is known to be no identifier, and else null."""
    base, failed = matches(text)
    alone = lambda a, b: not (text[a - 1:a].isalnum() or text[b:b + 1].isalnum())  # noqa: E731  else digits of a longer token
    found: list[tuple[int, int, str | None]] = [(a, b, k) for a, b, k in base if k == "email" or alone(a, b)]
    found += [(a, b, "none") for a, b in failed if alone(a, b) and not any(x < b and a < y for x, y, _ in base)]
    taken = sorted((a, b) for a, b, _ in found)
    spans = [m.span() for p in (_TOKEN, _GROUPS) for m in p.finditer(text)] if "@" in text or _DIGIT.search(text) else []
    at, last = 0, 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a < last or (at < len(taken) and taken[at][0] < b):
            continue
        last = b
        value = text[a:b].lower()
        secret = b - a >= SECRET and _HEX.fullmatch(value)
        found.append((a, b, "key" if secret and _number(value) % SEED_SHARE == 0 else None))
    out = []
    for a, b, label in found:
        value = text[a:b]
        kind = shape(value)
        out.append((a, b, f"{kind}<{left_context(text, a)}", f"{kind}>{right_context(text, b)}", value.lower(), form(value), label))
    return out


_CAND = "start: bigint, stop: bigint, left: bigint, right: bigint, instance: bigint, form: string, label: string"


def _spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus base spans and candidates, from one reading of the text."""
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())])
    names = ("start", "stop", "left", "right", "instance", "form", "label")
    cand = pa.struct([(n, pa.string() if n in ("form", "label") else pa.int64()) for n in names])

    def make(texts: list[str]) -> list[pa.Array]:
        spans, cands = [], []
        for t in texts:
            some = "@" in t or _DIGIT.search(t)
            spans.append([{"start": a, "stop": b, "kind": k} for a, b, k in (base_spans(t) if some else [])])
            cands.append([dict(zip(names, (a, b, _number(p), _number(q), _number(v), f, s))) for a, b, p, q, v, f, s in (candidates(t) if some else [])])
        return [pa.array(spans, pa.list_(kind)), pa.array(cands, pa.list_(cand))]

    return added(docs, text, f"base array<struct<start: bigint, stop: bigint, kind: string>>, cands array<struct<{_CAND}>>", make, strings)


def confident_patterns(edges: DataFrame, *, rounds: int = 6, least: float = 0.8, seeds: int = 3) -> DataFrame:
    """(pattern, kind, confidence) with final confidence of at least ``least``.

    ``edges`` has distinct (pattern, instance, form, label). Seeds score 1,
    failed matches 0, and both keep it; others begin with 0. In a round, the
    confidence of a pattern that holds ``seeds`` seeds or more is the mean score
    of its instances, and the score of another instance is 1 - the product over
    its patterns of (1 - confidence x likeness). The likeness is the share of
    seeds among the labelled instances of its form, 0 if there are none, so that
    what never looks like a seed counts against its patterns.
    """
    facts = stage(edges, "pii-edges")
    each = facts.groupBy("instance").agg(F.max("form").alias("form"), F.max("label").alias("label"))
    forms = each.where("label IS NOT NULL").groupBy("form").agg(F.avg(F.when(F.col("label") != "none", 1.0).otherwise(0.0)).alias("likeness"))
    start = F.when(F.col("label").isNull() | (F.col("label") == "none"), 0.0).otherwise(1.0)
    each = stage(each.join(forms, "form", "left").select("instance", "label", F.coalesce("likeness", F.lit(0.0)).alias("likeness"), start.alias("score")), "pii-instances")
    pairs = facts.select("pattern", "instance").distinct()
    seed = F.col("label").isNotNull() & (F.col("label") != "none")
    scores = each
    for turn in range(rounds):
        rated = pairs.join(scores, "instance")
        patterns = rated.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(seed).alias("support"), F.mode(F.when(seed, F.col("label")), True).alias("kind"))
        patterns = stage(patterns.where(F.col("support") >= seeds).select("pattern", "kind", "confidence"), f"pii-patterns{turn}")
        if turn == rounds - 1:
            break
        lent = pairs.join(patterns.select("pattern", "confidence"), "pattern").join(each.where("label IS NULL").select("instance", "likeness"), "instance")
        lent = lent.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence") * F.col("likeness"), F.lit(1e-9)))))).alias("lent"))
        scores = stage(each.join(lent, "instance", "left").select("instance", "label", F.coalesce("lent", "score").alias("score")), f"pii-scores{turn}")
    return patterns.where(F.col("confidence") >= least)


def personal_data(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """A row per row of ``docs``: doc_id, base (spans by start, then kind) and
    found (spans that patterns add, outside base spans, and whether a seed
    names them), in code points.

    Null and empty texts have none. Repeated rows keep a row each (the graph
    counts distinct instances, so copies lend no weight). A candidate in several
    patterns takes the kind of the most confident, ties by name, as do ties
    between kinds of a pattern. Other columns are not carried; an empty table
    gives an empty one.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stage(_spans(slim, "text").drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    each = rows.where(F.size("cands") > 0).select("row", F.explode("cands").alias("c")).select("row", "c.*")
    each = each.withColumn("pattern", F.explode(F.array("left", "right")))
    patterns = confident_patterns(each.groupBy("pattern", "instance").agg(F.max("form").alias("form"), F.max("label").alias("label")), **options)
    hits = each.where("label IS NULL OR label = 'key'").join(patterns, "pattern")
    best = F.max(F.struct("confidence", "kind")).alias("best")
    hits = hits.groupBy("row", "start", "stop").agg(best, F.max(F.col("label").isNotNull()).alias("seed"))
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("best.kind").alias("kind"), "seed"))).alias("found"))
    none = F.array().cast("array<struct<start: bigint, stop: bigint, kind: string, seed: boolean>>")
    return rows.join(hits, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans
    that patterns add) and n_unseen (of these, those that no seed names)."""
    out = personal_data(docs, **options)

    def text_of(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "key")]), s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    counts = [count_of(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", plain)).alias("spans"), F.size("found").cast("long").alias("n_found"), F.size(F.filter("found", lambda s: ~s["seed"])).cast("long").alias("n_unseen"))
