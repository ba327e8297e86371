"""SimHash, decontamination, language, personal data, pages, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from notegrid.llm import decontam, golay, htmltext, langid, nearcopies, pii, simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    """(id, fingerprint) -> smallest id reachable, None if there is none."""
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(pairs))]


def test_fingerprint_matches_native(spark):
    text = "Some Words, in a ROW ünd more of them"
    words = text.replace("S", "s").replace("W", "w").replace("ROW", "row").lower().split()
    shingle = " ".join(words[:3])
    native = spark.createDataFrame([(shingle,)], "s string").selectExpr("xxhash64(s)").first()[0]
    assert simhash.fingerprint(shingle.encode()) == native % (1 << 64)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400).astype(np.uint32)
    codes = golay.decode(words)
    assert set(map(len, (set(r) for r in golay.keys(words).tolist()))) <= {1, 6}
    for flips in (1, 2):
        for w in words[:100]:
            other = w
            for b in rng.choice(23, flips, replace=False):
                other ^= np.uint32(1 << int(b))
            assert set(golay.keys(np.array([w]))[0].tolist()) & set(golay.keys(np.array([other]))[0].tolist())
    assert codes.max() < 1 << 12


@pytest.mark.parametrize("others", [1, 2])
def test_golay_keys_meet(others):
    rng = random.Random(3)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice((1, 2))):
            b ^= 1 << bit
        row, key = simhash.golay_keys(np.array([a, b], dtype=np.uint64), others)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_links_connect_like_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    rng = random.Random(bucket)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            value = centre
            for bit in rng.sample(range(64), rng.choice((0, 1, 2, 3))):
                value ^= 1 << bit
            values.add(value)
            centre = rng.choice((centre, value))
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    from notegrid.llm.common import components

    roots = {r.node % (1 << 64): r.root for r in components(spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in links], "a long, b long"), "t").collect()}
    groups = Counter(brute_components([(k, v) for k, v in enumerate(values)]))
    ours = Counter(roots.get(v, f"alone {v}") for v in values)
    assert sorted(groups.values()) == sorted(ours.values())


def test_simhash(docs, rows, clashing, empty):
    pairs = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))), key=str)
    got = simhash.simhash_components(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.simhash_components(empty).collect() == []
    texts = spark_ids(docs, "string")
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(texts).collect()), key=str) == want_of_texts(pairs)


def spark_ids(docs, kind):
    return docs.withColumn("doc_id", docs.doc_id.cast(kind))


def want_of_texts(pairs):
    pairs = [(None if i is None else str(i), f) for i, f in pairs]
    return sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))), key=str)


def test_simhash_real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows))}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_match():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        every = {(edit(item, text[a:b]), b) for a in range(len(text) + 1) for b in range(a, len(text) + 1)}
        assert decontam.best_match(item, text)[0] == min(d for d, _ in every)


def test_word_hashes():
    texts = [b"One two, TWO", b"", b"\xc3\xa9t\xc3\xa9 " + b"z" * 5000 + b" two", b"...", b"two"]
    hashes, offsets = decontam.word_hashes(texts * 40)
    assert offsets[:6].tolist() == [0, 3, 3, 6, 6, 7]
    assert hashes[1] == hashes[2] == hashes[5] == hashes[6] and len(set(hashes[:6].tolist())) == 4
    alone = [decontam.word_hashes([t])[0].tolist() for t in (b"abc de", b"abc")]
    many = decontam.word_hashes([b"abc de", b"abc"] * 100 + [b"longest word"])[0].tolist()
    assert alone[0][0] == alone[1][0] == many[0] == many[2] and alone[0][1] == many[1]
    assert decontam.word_hashes([b"x" * 3000])[0][0] == decontam.word_hashes([b"a " * 100 + b"x" * 3000])[0][-1]


def test_contaminations(spark, rows, docs, clashing, empty):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((5, 7, 8, 13, 30, 60))))) for k in range(40)]
    planted, texts = {}, []
    for d in range(240):
        words = rng.choices(vocabulary, k=rng.choice((0, 10, 200)))
        if d % 2:
            i, text = rng.choice(items)
            own = text.split()
            for _ in range(rng.randint(0, decontam.allowed(len(own)))):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                own[at:at + 1] = [["zz"], [], [own[at], "zz"]][kind]
            planted[d] = i
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append((d, " ".join(words)))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "w1 w2")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.contaminations(table, bench).collect()}
    words = dict(texts)
    for (d, i), r in found.items():
        own, part = dict(items)[i].split(), words[d].split()[r.first_word:r.last_word]
        assert edit(own, part) == r.distance <= decontam.allowed(len(own))
    caught = sum((d, i) in found for d, i in planted.items())
    assert caught >= 0.99 * len(planted)
    assert {d for d, _ in found} <= set(planted)
    again = decontam.contaminations(table, bench, block=300)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == set(found)
    assert decontam.decontaminated(clashing, bench).columns == clashing.columns and decontam.decontaminated(clashing, bench).count() == len(rows)
    clean = decontam.decontaminated(table, bench, block=2000)
    assert {r.doc_id for r in clean.collect()} == set(words) - {d for d, _ in found}
    assert decontam.contaminations(docs, bench).collect() == []
    assert decontam.decontaminated(docs, bench).count() == len(rows)
    assert decontam.contaminations(empty, bench).collect() == [] and decontam.contaminations(docs, bench.limit(0)).collect() == []
    for kind in ("smallint", "date"):
        named = spark.createDataFrame([(1, rows[0][1])], "n int, text string").selectExpr("CAST(1 AS SMALLINT) AS item_id" if kind == "smallint" else "DATE'2020-01-02' AS item_id", "text")
        assert dict(decontam.contaminations(docs, named).dtypes)["item_id"] == kind and decontam.contaminations(docs, named).count() == 3
    line = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert sorted(decontam.contaminations(docs, line).toPandas().doc_id.fillna(-1).tolist()) == [-1, 1, 2]


def test_edited_items_are_found(sf_dir):
    """Recall of the sampled coordinates against exact distances, for items edited up to the limit."""
    import pyarrow.parquet as pq

    rng = random.Random(5)
    rows = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    items = decontam.Items([(r["item_id"], r["text"]) for r in rows])
    place = {name: k for k, name in enumerate(items.ids)}
    texts, wanted = [], []
    for r in rows:
        if r["item_id"] not in place:
            continue
        most = decontam.allowed(len(items.lists[place[r["item_id"]]]))
        for edits in (0, most // 2, most):
            words = r["text"].split()
            for _ in range(edits):
                at, new = rng.randrange(len(words)), f"zq{rng.randrange(5000)}"
                words[at:at + 1] = ([new], [], [new, words[at]])[rng.randrange(3)]
            pad = [f"zq{rng.randrange(5000)}" for _ in range(80)]
            texts.append(" ".join([*pad[:40], *words, *pad[40:]]).encode())
            wanted.append((r["item_id"], most))
    words, offsets = decontam.word_hashes(texts)
    found = {(t, items.ids[i]): n for t, i, n, _, _ in items.search(words, offsets)}
    near = exact = hits = 0
    for t, (name, most) in enumerate(wanted):
        distance, _ = decontam.best_match(items.lists[place[name]], words[offsets[t]:offsets[t + 1]].tolist())
        if distance <= most:
            near, hits = near + 1, hits + ((t, name) in found)
        if distance == 0:
            exact += 1
            assert found[t, name] == 0
    assert exact and hits >= 0.97 * near


def test_language(spark, docs, rows, clashing, empty):
    sf = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.language_id(real).where("held_out").join(real.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) > 150 and (out.lang_pred == out.lang).mean() >= 0.98
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    without_letter = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == without_letter
    import zlib

    assert {(r.doc_id, r.held_out) for r in got} == {(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows}
    kept = langid.in_known_language(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or '') for r in rows)
    assert langid.language_id(empty).collect() == [] and langid.in_known_language(empty).collect() == []


def test_letters():
    assert all(langid.grams(t) is None for t in ("", "12 34", "_ - !", "½ ²", "\u0660\u0661"))
    assert all(langid.grams(t) is not None for t in ("a", "½ a", "ж1", "語"))


def test_mixture_of_languages():
    rng = np.random.default_rng(2)
    tables = rng.dirichlet(np.full(50, 0.3), 3)
    model = langid.Model(["a", "b", "c"], np.zeros((3, langid.BUCKETS)))
    counts = rng.multinomial(3000, 0.7 * tables[0] + 0.3 * tables[2]).astype(float)
    rates = np.ascontiguousarray(tables.T) + 1e-6
    found = model.mixture(counts, rates, 4.0, 50)
    assert [n for n, _ in found] == ["a", "c"] and abs(found[0][1] - 0.7) < 0.08 and abs(sum(x for _, x in found) - 1) < 1e-6
    assert model.mixture(rng.multinomial(3000, tables[1]).astype(float), rates, 4.0, 50) == [("b", 1.0)]
    for _ in range(50):  # no proportions pass the bound, however early the rounds end
        counts = rng.multinomial(rng.integers(1, 400), tables[rng.integers(3)]).astype(float)
        upper = langid.em(counts, rates, int(rng.integers(1, 6)))[2]
        assert upper >= max(counts @ np.log(rates @ w) for w in rng.dirichlet(np.ones(3), 300)) - 1e-9


def brute_languages(rows, penalty=4.0, rounds=25, tolerance=1e-3):
    """languages of each (id, text, lang), by dictionaries and loops over the letters of the text."""
    import math
    import zlib

    def counts(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return None
        units = f" {' '.join(words)} ".encode("utf-16-le")
        units = [units[k] | units[k + 1] << 8 for k in range(0, len(units), 2)]
        out = Counter()
        for x, y, z in zip(units, units[1:], units[2:]):
            mixed = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
            mixed ^= mixed >> 15
            out[(mixed * 0x2C1B3C6D & 0xFFFFFFFF) >> 18] += 1
        return out

    learned = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang].update(counts(text) or {})
    names = sorted(learned)
    size = {n: sum(learned[n].values()) + 0.2 * langid.BUCKETS for n in names}
    rate = lambda n, g: (learned[n][g] + 0.2) / size[n]

    def em(own, some):
        table = [(c, [rate(n, g) for n in some]) for g, c in own.items()]
        shares, total = [1 / len(some)] * len(some), sum(own.values())
        for _ in range(rounds):
            after = [0.0] * len(some)
            for c, r in table:
                mixed = sum(map(float.__mul__, r, shares))
                for k, x in enumerate(r):
                    after[k] += c * x * shares[k] / mixed / total
            moved = max(abs(a - b) for a, b in zip(after, shares))
            shares = after
            if moved < tolerance:
                break
        return shares, sum(c * math.log(sum(map(float.__mul__, r, shares))) for c, r in table)

    out = []
    for _, text, _ in rows:
        own = counts(text)
        if own is None:
            out.append([])
            continue
        price = penalty * (1 + math.log(sum(own.values())))
        alone = {n: sum(c * math.log(rate(n, g)) for g, c in own.items()) for n in names}
        chosen = [max(names, key=lambda n: alone[n])]
        best, shares = alone[chosen[0]], [1.0]
        every = dict(zip(names, em(own, names)[0]))
        for n in sorted((n for n in names if n not in chosen), key=lambda n: -every[n]):
            trial = em(own, [*chosen, n])
            if trial[1] - best <= price:
                break
            chosen, (shares, best) = [*chosen, n], trial
        out.append(sorted(zip(chosen, shares), key=lambda x: -x[1]))
    return out


def test_languages_like_brute_force(spark, sf_dir):
    """The whole query against loops, with texts that mix languages."""
    rows = [(r.doc_id, r.text and r.text[:1500], r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()][:90]
    texts = {lang: next(t for _, t, x in rows if x == lang and len(t or "") > 300) for lang in ("en", "de", "fr")}
    rows += [(9000, texts["en"][:300] + " " + texts["fr"][:250], None), (9001, " ".join(t[:200] for t in texts.values()), None), (9002, "12 34", None), (9003, None, "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.language_id(table).collect()}
    for (i, _, _), want in zip(rows, brute_languages(rows)):
        found = [(x.lang, x.share) for x in got[i].languages]
        assert [n for n, _ in found] == [n for n, _ in want] and all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(found, want))
        assert (got[i].lang_pred, got[i].score) == (found[0] if found else ("und", 0.0))
    assert len(got[9000].languages) == 2 and got[9001].languages


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(("a", "Z", "9", "1", "255", "4111111111111111", ".", ".", "@", "@", " ", "-", "+", "(", "😀", "%")) for _ in range(rng.randrange(1, 25)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)) == brute_spans(text), text


def test_personal_data(spark, docs, rows, clashing, empty, sf_dir):
    got = pii.pii_report(docs).collect()
    want = sorted(((r[0], hashlib.sha256(brute_spans(r[1]).encode()).hexdigest()) for r in rows), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want
    for r in got:
        base = brute_spans(dict((x[0], x[1]) for x in rows)[r.doc_id])
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    for r in pii.pii_report(real).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_email == base.count("email:") and r.n_ip == base.count("ip:") and r.n_card == base.count("card:") and r.n_phone == base.count("phone:")
    assert pii.pii_report(empty).collect() == [] and pii.pii_report(clashing).count() == len(rows)


def brute_found(texts, rounds=6, least=0.8, seeds=3):
    """The added spans of texts by loops over lists, in the order of the text."""
    cands = [(t, *c) for t, x in enumerate(texts) for c in pii.candidates(x or "")]
    label, form, members = {}, {}, defaultdict(set)
    for _, _, _, left, right, value, f, lab in cands:
        label[value] = max(filter(None, (label.get(value), lab)), default=None)
        form[value] = max(form.get(value, ""), f)
        members[left].add(value)
        members[right].add(value)
    known = defaultdict(list)
    for v, lab in label.items():
        if lab:
            known[form[v]].append(lab != "none")
    like = {v: sum(known[form[v]]) / len(known[form[v]]) if known[form[v]] else 0.0 for v in label}
    first = {v: float(lab not in (None, "none")) for v, lab in label.items()}
    score = dict(first)
    for turn in range(rounds):
        worth = {}
        for p, own in members.items():
            if sum(first[v] for v in own) >= seeds:
                kinds = Counter(label[v] for v in own if first[v])
                worth[p] = (sum(score[v] for v in own) / len(own), min(k for k in kinds if kinds[k] == max(kinds.values())))
        for v in score:
            mine = [worth[p][0] for p in members if v in members[p] and p in worth]
            if label[v] is None and mine:
                score[v] = 1 - np.prod([1 - w * like[v] for w in mine])
    found = defaultdict(dict)
    for t, a, b, left, right, value, f, lab in cands:
        mine = [worth[p] for p in (left, right) if p in worth and worth[p][0] >= least]
        if lab in (None, "key") and mine:
            found[t][a, b] = (max(mine)[1], lab is not None)
    return [sorted((a, b, k, s) for (a, b), (k, s) in found[t].items()) for t in range(len(texts))]


def _secret(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def test_patterns_discover(spark, sf_dir):
    """Contexts of seeds find what no base pattern matches, as loops over the same graph do."""
    texts = [f'some words then secret token = "{_secret(k)}" and more {k}' for k in range(24)]
    texts += ['other text with secret token = "9af3b2c1" after', "order number = 12345678 is none", f"a digest {_secret(99)} of a file", None, ""]
    texts += [f"call me at +49 30 {5550000 + k} today" for k in range(8)] + ["call me at (030) 555-7788 today", "call me at 99 today"]
    texts += [f"paid with card {4111111111111111 + 0 * k} of {k}" for k in range(4)] + [f"paid with card {4000000000000000 + 7 * k} of {k}" for k in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(f) for f in r.found] for r in pii.personal_data(table).collect()}
    assert [got[k] for k in range(len(texts))] == brute_found(texts)
    assert [texts[24][a:b] for a, b, _, _ in got[24]] == ["9af3b2c1"] and got[24][0][2:] == ("key", False)
    assert all(len(got[k]) == 1 for k in range(24)) and not got[25] and not got[26]
    assert [(texts[37][a:b], k) for a, b, k, _ in got[37]] == [("(030) 555-7788", "phone")]
    assert not any(got[k] for k in range(39, len(texts)))  # numbers that fail the check stay out
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in real]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(f) for f in r.found] for r in pii.personal_data(table).collect()}
    assert [got[k] for k in range(len(texts))] == brute_found(texts)


def test_unseen_identifiers(spark):
    """At the scale that has enough of them: most secrets are found without being seeds, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = pii.personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    secrets = lambda t: {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', (t or "").lower())}
    found = [((f.start, f.stop) in secrets(r.text), f.seed) for r in out for f in r.found]
    assert all(true for true, _ in found) and sum(not seed for _, seed in found) >= 50
    assert len(found) >= 0.95 * sum(len(secrets(r.text)) for r in out)


def test_contexts():
    text = 'one two\n  ' + "x" * 200 + ' token: "ab12" next\nlast'
    at = text.index("ab12")
    assert pii.left_context(text, at) == "x" * 200 + ' token: "' and pii.right_context(text, at + 4) == '" next'
    assert pii.left_context(text, 0) == "^ " and pii.right_context(text, len(text)) == " $"


def prefix_lengths(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        last = row[:]
        for i, x in enumerate(a):
            row[i + 1] = last[i] + 1 if x == y else max(last[i + 1], row[i])
    return row


def brute_common(a, b):
    """The pairs of common_lines by full tables: b halved where both halves share most, first on ties."""
    if not a or not b:
        return []
    if len(b) == 1:
        return [(a.index(b[0]), 0)] if b[0] in a else []
    m = len(b) // 2
    last = prefix_lengths(a[::-1], b[m:][::-1])[::-1]
    both = [x + y for x, y in zip(prefix_lengths(a, b[:m]), last)]
    cut = both.index(max(both))
    return brute_common(a[:cut], b[:m]) + [(i + cut, j + m) for i, j in brute_common(a[cut:], b[m:])]


def test_common_lines():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        pairs = htmltext.common_lines(a, b)
        assert len(pairs) == prefix_lengths(a, b)[-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a, b = ([rng.randrange(40_000) for _ in range(30_000)] for _ in range(2))
    a[5_000:9_000] = b[20_000:24_000]
    assert len(htmltext.common_lines(a, b)) >= 4_000


def test_pages_like_brute_force(spark, monkeypatch):
    """The whole query against plain loops over pages whose lines and zones are
    known, on hosts of one page to many chunks, with lines that only two neighbours share."""
    monkeypatch.setattr(htmltext, "CHUNK", 8)
    rng = random.Random(21)
    menu, ads = [f"menu {k}" for k in range(6)], [f"ad {k}" for k in range(400)]
    wrap = {"free": "<div>{}</div>", "aside": "<nav>{}</nav>", "main": "<p>{}</p>", "doubt": "<div class='share'>{}</div>", "hint": "<div class='sidebar'>{}</div>"}
    pages = []
    for host, n in (("a", 1), ("b", 7), ("c", 8), ("d", 9), ("e", 40), ("f", 17)):
        for k in range(n):
            article = rng.random() < 0.4
            top = [("free", rng.choice(menu)) for _ in range(rng.randrange(3))] + [("aside", rng.choice(menu))] + [("hint", rng.choice(ads))]
            body = [("free", f"line {host} {rng.randrange(12)}") for _ in range(rng.randrange(5))]
            text = [(rng.choice(("main", "main", "doubt")), f"story {host} {rng.randrange(10)}") for _ in range(rng.randrange(1, 5))] if article else []
            html = lambda part: "".join(wrap[z].format(x) for z, x in part)
            pages.append((len(pages), f"http://{host}.example/{rng.randrange(30):03d}", top + body + text, "<body>" + html(top + body) + (f"<article>{html(text)}</article>" if article else "")))
    order = sorted(pages, key=lambda p: (p[1], p[0]))
    shared = {p[0]: set() for p in pages}
    for p, q in zip(order, order[1:]):
        if p[1].split("/")[2] == q[1].split("/")[2]:
            own, other = ([x for _, x in r[2]] for r in (p, q))
            keep = [[k for k, x in enumerate(lines) if x in rest] for lines, rest in ((own, other), (other, own))]
            for i, j in brute_common([own[k] for k in keep[0]], [other[k] for k in keep[1]]):
                shared[p[0]].add(keep[0][i])
                shared[q[0]].add(keep[1][j])
    want, told = [], []
    for i, url, lines, _ in pages:
        article = any(z == "main" for z, _ in lines)
        stays = [z == "main" or (z == "doubt" and k not in shared[i]) or (z == "free" and not article and k not in shared[i]) for k, (z, _) in enumerate(lines)]
        text = "\n\n".join(x for (_, x), s in zip(lines, stays) if s)
        kept = sum(k in shared[i] for k, (z, _) in enumerate(lines) if z == "main")
        cut = sum(k not in shared[i] for k, (z, _) in enumerate(lines) if z in ("aside", "hint") or (z == "free" and article))
        want.append((i, url, text, len(text)))
        told.append((i, url, len(lines), len(shared[i]), kept, cut))
    table = spark.createDataFrame([(i, u, h) for i, u, _, h in pages], "page_id long, url string, html string").repartition(5)
    assert sorted(map(tuple, htmltext.main_text(table).collect())) == want
    assert sorted(map(tuple, htmltext.difference_report(table).collect())) == told
    assert sum(map(len, shared.values())) > 100


def test_chunk_edge(spark):
    """A line that only two neighbours share goes, wherever the chunks of a host part."""
    rows = [(k, f"http://h.example/{k:05d}", f"<div>story {k}</div><div>pair {k // 2 if k < 64 else (k + 1) // 2}</div>") for k in range(200)]
    rows = [(k, u, h if k not in (63, 64) else f"<div>story {k}</div><div>the edge</div>") for k, u, h in rows]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[63] == "story 63" and out[64] == "story 64" and out[10] == "story 10"


def test_implied_end_tags():
    zones = lambda t: [(z, x) for z, x in htmltext.page_blocks(t)]
    assert zones("<html><head><title>t</title><body><p>one<article><p class='share'>two<p>three</article>") == [(htmltext.ASIDE, "t"), (htmltext.FREE, "one"), (htmltext.DOUBT, "two"), (htmltext.MAIN, "three")]
    assert zones("<head><title>t</title><p>one") == [(htmltext.ASIDE, "t"), (htmltext.FREE, "one")]
    assert zones("<ul><li class='menu'>a<ul><li>b</ul>c<li>d</ul>") == [(htmltext.ASIDE, "a"), (htmltext.ASIDE, "b"), (htmltext.ASIDE, "c"), (htmltext.FREE, "d")]


ARTICLE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy <div>now</div></div>{}<footer>&copy; x</footer>"


def test_pages(spark):
    page = lambda *lines: "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"
    rows = [
        (1, "https://a.example/x/1", ARTICLE.replace("{}", "<article><h1>Head &amp;  line</h1><p><b>one\n two<br>three<p>four &lt;b&gt; &am</article>")),
        (2, "https://a.example/x/2", ARTICLE.replace("{}", "<main><p>one</p><aside>no</aside><form>no</form><div id='comments'><p>no</p></div><section class='related-posts'>no</section><p>two</p></main>")),
        (3, "http://b.example/p/1?u=1", page("Shop", "first story", "Contact us")),
        (4, "http://b.example/p/2#top", page("Shop", "second story", "and more", "Contact us")),
        (5, "http://b.example/p/3", page("Shop", "third story", "Contact us")),
        (6, "http://c.example/", page("alone", "alone too")),
        (7, None, None), (8, "not a url", ""), (9, "http://d.example/1", "<p>unclosed <b>bold &#233;&nbsp;x"), (9, "http://d.example/1", "<p>unclosed <b>bold &#233;&nbsp;x"),
    ]
    out = {(r.page_id, r.url): r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    text = {k[0]: r.text for k, r in out.items()}
    assert text[1] == "Head & line\n\none two three\n\nfour <b> &am"
    assert text[2] == "one\n\ntwo"
    assert (text[3], text[4], text[5]) == ("first story", "second story\n\nand more", "third story")
    assert text[6] == "alone\n\nalone too" and text[7] == text[8] == text[9] == ""
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hot_host(spark):
    """A host of many chunks loses the same lines as a small one."""
    rows = [(k, f"http://h.example/{k:05d}", f"<body><div>Menu</div><div>story {k}</div><div>Imprint</div>") for k in range(300)]
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in out) == [(k, f"story {k}") for k in range(300)]


def test_pipeline(spark, tmp_path):
    """Against a version of plain loops on one small table."""
    import sys

    from tests.llm.conftest import SCHEMA
    from tests.llm.test_counting import brute_mix, brute_shards

    pipeline = pytest.importorskip("corpus_pipeline")
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    rng = random.Random(8)
    words = {"en": "the of and to in house river stone green walk talk window morning".split(), "de": "der die und nicht haus fluss stein gehen fenster schule straße über".split()}
    texts = []
    for k in range(60):
        lang = rng.choice(("en", "de"))
        texts.append((k, " ".join(rng.choices(words[lang], k=rng.choice((6, 40, 90)))), lang, rng.choice("abc")))
    item = " ".join(f"bench{k}" for k in range(20))
    texts += [(100 + k, texts[k][1], texts[k][2], "b") for k in range(8)] + [(200, texts[3][1] + " " + item, "en", "a"), (201, "12 34", "en", "a"), (202, None, None, None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in texts]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = [tuple(r[:5]) + (r.shard_id,) for r in pipeline.run(spark, sf).select("doc_id", "text", "lang", "source", "n_chars", "shard_id").collect()]

    left = [r for r, p in zip(rows, brute_languages([(r[0], r[1], r[2]) for r in rows])) if p and p[0][1] >= 0.5]
    left = brute_deduplicated(left)
    left = [r for r in left if item not in r[1]]
    _, _, _, taken = brute_mix(left)
    left = [r for k, r in enumerate(left) for _ in range(taken[k])]
    hashes = [(int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), len(r[1].encode())) for r in left]
    names = brute_shards(hashes, 1 << 20)
    assert sorted(got) == sorted((*r, names[h[0]]) for r, h in zip(left, hashes))
    assert "corpus_pipeline" in sys.modules


def brute_deduplicated(rows):
    """Rows (id, text, ...) whose id is the smallest of those that similarities of 0.8 connect."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").split() for r in rows]
    grams = [{" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                low, high = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[high] = low
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_near_copies(spark, clashing, empty):
    """The stage's groups against brute-force Jaccard over 5-word shingles, with a group over PAIR_BUCKET."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(rng.choice((3, 30, 120)))) for _ in range(40)]
    for base in [texts[k] for k in range(0, 40, 3)]:
        for edits in (0, 1, 2, 4, 8):
            words = base.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    hot = [word() for _ in range(200)]
    for _ in range(90):
        words = list(hot)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(1000, None), (1001, " "), (1002, "")]
    want = brute_deduplicated(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    stage = pytest.importorskip("corpus_pipeline").near_duplicates
    assert sorted(map(tuple, stage(spark, table, "").collect())) == sorted(want)
    assert sorted(map(tuple, stage(spark, table.select(table.doc_id.cast("string").alias("doc_id"), "text"), "").collect()))[0][0] == "0"
    kept = simhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]
    assert simhash.deduplicated(empty).collect() == []


def test_sieve(spark):
    """The bitmap loses no row that is wanted and passes few others."""
    docs = spark.range(20_000).selectExpr("xxhash64(id) AS _ng_d1", "id")
    for part in (1, 50, 20_000):
        wanted = docs.where(f"id % {20_000 // part} = 0").selectExpr("_ng_d1 AS _ng_1", "id AS _ng_2")
        passed = nearcopies.sieved(docs, wanted)
        assert passed.columns == docs.columns and wanted.join(passed, wanted["_ng_1"] == passed["_ng_d1"], "left_anti").count() == 0
        assert wanted.count() <= passed.count() <= wanted.count() + 2000


def test_near_copies_with_repeated_ids(spark):
    """Ids name no row: a repeated id loses no document and keeps no copy."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = lambda *r: sorted(map(tuple, simhash.deduplicated(spark.createDataFrame(r, "doc_id long, text string")).collect()), key=str)
    assert rows((5, one), (5, two)) == [(5, one), (5, two)]
    assert rows((5, one), (5, two), (3, two)) == [(3, two), (5, one)]
    assert rows((5, one), (5, one), (None, one), (None, two), (None, two)) == [(5, one), (None, two)]


@pytest.mark.parametrize("pivots, block", [(0, 600), (2, 600), (2, 1 << 16)])
def test_hot_buckets_connect_like_all_pairs(spark, monkeypatch, pivots, block):
    """Groups over PAIR_BUCKET with similarities on both sides of 0.8, in blocks of any size."""
    monkeypatch.setattr(nearcopies, "PIVOTS", pivots)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "PAIR_BUCKET", 6)
    rng = random.Random(11)
    texts = []
    for base in range(3):
        hot = [f"b{base}w{k}" for k in range(60)]
        for _ in range(50):
            words = list(hot)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    want = [i for i, _ in brute_deduplicated(list(enumerate(texts)))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(table).collect()) == want


def test_long_edited_items_are_found():
    """Every item of 100 to 500 words within its limit, among items of its length."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(40000)}"
    given = [[word() for _ in range(n)] for n in (100, 250, 500) for _ in range(8)]
    items = decontam.Items([(k, " ".join(w)) for k, w in enumerate(given)])
    texts, wanted = [], []
    for k, own in enumerate(given):
        for share in (0.1, 0.15, 0.2):
            words = list(own)
            for _ in range(int(share * len(own))):
                at = rng.randrange(len(words))
                words[at:at + 1] = ([word()], [], [word(), words[at]])[rng.randrange(3)]
            texts.append(" ".join([*[word() for _ in range(300)], *words, *[word() for _ in range(200)]]).encode())
            wanted.append(k)
    words, offsets = decontam.word_hashes(texts)
    found = {(t, items.ids[i]) for t, i, _, _, _ in items.search(words, offsets)}
    assert len(found & set(enumerate(wanted))) >= len(wanted) - 1 and found <= set(enumerate(wanted))


@pytest.mark.parametrize("n", [8, 13, 24, 35, 47])
def test_recall_of_the_walks(n):
    """Pieces at their limit, among many others, are met as often as stated, for words of a small vocabulary too."""
    rng = random.Random(n)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 3000}"
    given = [[word() for _ in range(n)] for _ in range(300)]
    items = decontam.Items([(k, " ".join(w)) for k, w in enumerate(given)])
    texts = []
    for own in given:
        words = list(own)
        for _ in range(decontam.allowed(n)):
            at = rng.randrange(len(words))
            words[at:at + 1] = ([word()], [], [word(), words[at]])[rng.randrange(3)]
        texts.append(" ".join([*[word() for _ in range(30)], *words, *[word() for _ in range(30)]]).encode())
    words, offsets = decontam.word_hashes(texts)
    near = {(t, t) for t in range(300) if decontam.best_match(items.lists[t], words[offsets[t]:offsets[t + 1]].tolist())[0] <= decontam.allowed(n)}
    found = {(t, items.ids[i]) for t, i, _, _, _ in items.search(words, offsets)}
    assert len(near & {(t, k) for t, k in found}) >= 0.99 * len(near) and len(near) == 300


def test_short_items_are_found():
    """Items of 1 to 4 words word for word, of 5 to 9 with one edit, and nothing beyond."""
    for n in range(1, 10):
        own = [f"i{k}" for k in range(n)]
        items = decontam.Items([(1, " ".join(own)), (2, "...")])
        edited = [own]
        for at in range(n):
            edited += [[*own[:at], *new, *own[at + 1:]] for new in (["x"], [], ["x", own[at]])]
        edited += [["x"] * 2 + own[2:], own[:-2] + ["x"] * 2]
        texts = [" ".join(["a", "b", *words, "c", "d"]).encode() for words in edited] + [" ".join(own[:n // 2]).encode(), " ".join(own[n // 2:]).encode()]
        words, offsets = decontam.word_hashes(texts)
        lists = [words[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        want = {(t, d) for t, text in enumerate(lists) if (d := decontam.best_match(items.lists[0], text)[0]) <= n // 5}
        assert {(t, d) for t, _, d, _, _ in items.search(words, offsets)} == want and (0, 0) in want


def test_patterns_at_line_starts(spark):
    """A label that begins a line is a pattern, and an address needs no digit in its text."""
    texts = [f"note\ntoken: {_secret(k)}" for k in range(24)] + ["some words\ntoken: 0123abcd"]
    texts += [f"login user@mail{'abcdefghi'[k]}.example" for k in range(9)] + ["login anna@localhost", "we saw 123456 there"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][f.start:f.stop] for f in r.found] for r in pii.personal_data(table).collect()}
    assert found[24] == ["0123abcd"] and found[34] == ["anna@localhost"] and found[35] == []
