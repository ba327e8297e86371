"""Operator 2: license scan with ordered signature rules.

A text becomes its words, lower-cased and joined by single spaces; rules are
regular expressions over that line, written by hand for bodies, notices and
exceptions (license_texts) and formed of names and versions for the rest. A rule runs only if the text has all its
keywords; detections that overlap are resolved by priority and containment.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import added, utf8
from notegrid.llm.common import without
from notegrid.llm.license_texts import keywords, signatures, split_up

#: Words are runs of digits, ASCII letters (lower-cased) and all non-ASCII bytes.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases and their labels that count as base detections (fixed values).
BASE = (
    (b"under the mit license", "mit"),
    (b"apache license version 2", "apache-2"),
    (b"cc by nc", "cc-by-nc"),
)

#: Families of licenses: label, names as they are written, versions (fixed values).
FAMILIES = (
    ("mit", ("mit", "expat"), ()),
    ("isc", ("isc",), ()),
    ("zlib", ("zlib",), ()),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl",), ()),
    ("bsd", ("bsd",), ("2 clause", "3 clause", "4 clause")),
    ("apache", ("apache",), ("1 0", "1 1", "2", "2 0")),
    ("gpl", ("gpl", "gnu gpl", "gnu general public"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("lgpl", "gnu lgpl", "gnu lesser general public"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("agpl", "gnu agpl", "gnu affero general public"), ("3", "3 0")),
    ("mpl", ("mpl", "mozilla public"), ("1 0", "1 1", "2 0")),
    ("epl", ("epl", "eclipse public"), ("1 0", "2 0")),
    ("cddl", ("cddl", "common development and distribution"), ("1 0", "1 1")),
    ("bsl", ("bsl", "boost software"), ("1 0",)),
    ("artistic", ("artistic",), ("1 0", "2 0")),
    ("eupl", ("eupl", "european union public"), ("1 1", "1 2")),
    ("ofl", ("ofl", "sil open font"), ("1 0", "1 1")),
    ("cc-by", ("cc by", "creative commons attribution"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
)

@dataclass(frozen=True)
class Rule:
    """One signature. Smaller ``order`` wins; ``keywords`` must all occur in the text."""

    order: int
    label: str
    pattern: re.Pattern
    keywords: frozenset
    score: float


@cache
def rules() -> tuple[Rule, ...]:
    """All signatures, most certain first, then those written by hand, then the
    longest: the hand-written ones, and each family's names and versions under
    each form a notice takes."""
    edge = r"(?<!\S)", r"(?!\S)"
    written = [(score, label, part, keywords(part)) for score, label, pattern in signatures() for part in split_up(pattern)]
    found = []
    for label, names, versions in FAMILIES:
        tails = [("", r"(?: licen[cs]e)?")]
        if label.endswith("gpl"):
            tails += [("-or-later", r" or (?:at your option )?(?:any )?later(?: version)?"), ("-only", r" only")]
        for name in names:
            words = tuple(name.split())
            creative = label.startswith("cc")
            for version in versions:
                tag = f"{label}-{version.replace(' clause', '').replace(' ', '.')}".removesuffix(".0")
                form = rf"{name} (?:licen[cs]e )?(?:version |v )?v?{version}" if not creative else rf"{name} (?:international |unported )?{version}"
                for mark, tail in tails:
                    found.append((1.0, tag + mark, rf"spdx license identifier {name} (?:v )?v?{version}{tail if mark else ''}", ("spdx", *words)))
                    given = rf"(?:licensed|released|distributed|published|available|redistribute it) (?:[^ ]+ ){{0,4}}?(?:under|with) (?:the )?(?:terms of the )?{form}{tail}"
                    found.append((0.95, tag + mark, given, words))
                    found.append((0.85, tag + mark, form + tail if creative or label in ("apache", "bsd") else rf"{name} licen[cs]e (?:version |v )?v?{version}{tail}", words))
            found.append((0.9, label, rf"spdx license identifier {name}", ("spdx", *words)))
            found.append((0.8, label, rf"(?:licensed|released|distributed|published|available) (?:[^ ]+ ){{0,4}}?under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?" if creative or len(words) > 1 else rf"(?:under|with) the (?:terms of the )?{name} licen[cs]e", words))
            if not creative or len(words) > 2 or name == "cc0":
                found.append((0.6, label, rf"{name} licen[cs]e", words))
    made, own = set(found), set(written)
    found = sorted(made | own, key=lambda r: (-r[0], r not in own, -len(r[2]), r[1], r[2]))
    return tuple(Rule(i, label, re.compile((edge[0] + pattern + edge[1]).encode()), frozenset(w.encode() for w in words), score)
                 for i, (score, label, pattern, words) in enumerate(found))


@cache
def _gates() -> dict[bytes, tuple[tuple[frozenset, tuple[Rule, ...]], ...]]:
    """The rules of each keyword set, by the word of it that fewest sets have,
    the longest on ties: a text without that word passes over them at once."""
    sets: dict[frozenset, list[Rule]] = {}
    for rule in rules():
        sets.setdefault(rule.keywords, []).append(rule)
    held = Counter(w for k in sets for w in k)
    out: dict[bytes, list] = {}
    for own, some in sets.items():
        out.setdefault(min(own, key=lambda w: (held[w], -len(w), w)), []).append((own, tuple(some)))
    return {w: tuple(x) for w, x in out.items()}


def places(line: bytes, phrase: bytes) -> list[int]:
    """Byte offsets where the phrase's words stand in a line of words."""
    out, at = [], line.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (not at or line[at - 1] == 32) and (end == len(line) or line[end] == 32):
            out.append(at)
        at = line.find(phrase, at + 1)
    return out


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that stay: in rule order, then the longer,
    then the earlier first, one stays unless a kept one holds it or is held by it.

    No kept one holds another, so by start they are sorted by end as well, and
    only the two beside a new one can hold it or be held by it."""
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in sorted(found, key=lambda d: (d[2].order, d[0] - d[1], d[0])):
        at = bisect_left(starts, start)
        before, after = kept[max(0, at - 1):at], kept[at:at + 1]
        held = any(b >= end for _, b, _ in before) or any(b <= end or a == start for a, b, _ in after)
        if not held:
            starts.insert(at, start)
            kept.insert(at, (start, end, rule))
    return kept


def scan(text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, base detections and rule detections, each by word
    positions (end exclusive), with label (and score)."""
    words = text.translate(_WORDS).split()
    line = b" ".join(words)
    offsets: list[int] = []  # of the words, made for the first detection

    def at(offset: int) -> int:
        """The word at or before a byte offset."""
        if not offsets:
            offsets.extend(accumulate((len(w) + 1 for w in words[:-1]), initial=0))
        return bisect_right(offsets, offset) - 1

    base = []
    for phrase, label in BASE:
        if phrase in line:
            n = phrase.count(b" ") + 1
            base += [(k, k + n, label) for k in map(at, places(line, phrase))]
    gates, present = _gates(), frozenset(words)
    found = []
    for word in gates.keys() & present:
        for needed, own in gates[word]:
            if needed <= present:
                for rule in own:
                    found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(line)]
    kept = [(at(a), at(b - 1) + 1, r.label, r.score) for a, b, r in resolve(found)]
    return len(words), sorted(base), kept


def license_scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, base (spans and labels of the base phrases),
    detections (spans, labels and scores of the rules) and score.

    Null and empty texts have no words and score 0. score is the largest score
    of a detection, 1 for a base phrase. Repeated rows and ties need nothing:
    each row depends on its own whole text. Added columns replace input columns
    of their names; an empty table gives an empty one.
    """
    span = "start: bigint, stop: bigint, label: string"
    schema = f"n_words bigint, base array<struct<{span}>>, detections array<struct<{span}, score: double>>, score double"

    def make(texts: list[bytes]) -> list[pa.Array]:
        n, base, kept, score = [], [], [], []
        for t in texts:
            words, b, d = scan(t)
            n.append(words)
            base.append([{"start": x[0], "stop": x[1], "label": x[2]} for x in b])
            kept.append([{"start": x[0], "stop": x[1], "label": x[2], "score": x[3]} for x in d])
            score.append(1.0 if b else max((x[3] for x in d), default=0.0))
        kind = [("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]
        return [pa.array(n, pa.int64()), pa.array(base, pa.list_(pa.struct(kind))), pa.array(kept, pa.list_(pa.struct([*kind, ("score", pa.float64())]))), pa.array(score, pa.float64())]

    return added(without(docs, ["n_words", "base", "detections", "score"]), text, schema, make, utf8)


def license_report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    out = license_scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.col("base.start")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      join(F.col("base.label")).alias("base_labels"), join(F.concat("base.label", "detections.label")).alias("labels"), "score")
