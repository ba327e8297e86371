"""Known answers of the kernels."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from notegrid.operators import decide, match, ordered, vectors


def notes(spark, rows, side):
    extra = ", flagged boolean" if side == "j" else ""
    return spark.createDataFrame(rows, f"string int, {side} int, x double, fret int{extra}")


def measure(spark, truth, pred, width=1000.0):
    t, p = notes(spark, truth, "i"), notes(spark, pred, "j")
    pairs = match.match_pairs(t.drop("fret"), p.drop("fret", "flagged"), ["string"], width * 0.01)
    return pairs, match.metrics(pairs, t, p, width, ["string"])


def test_metrics_by_hand(spark):
    truth = [(3, k, 37.0 * k + 5, 3 * k % 20) for k in range(8)]
    shifts = (0.0, 1.0, -2.0, 3.0, -4.0, 8.0)
    said = {1: 19, 4: 0, 5: None}
    pred = [(3, k, 37.0 * k + 5 + dx, said.get(k, 3 * k % 20), k in (1, 2, 5)) for k, dx in enumerate(shifts)] + [(5, 6, 20.0, 1, False)]
    _, out = measure(spark, truth, pred)
    m = out.first().asDict()
    assert (m["matched"], m["missing"], m["extra"], m["wrong_fret"], m["flagged"], m["flagged_errors"], m["unflagged_errors"]) == (6, 2, 1, 3, 3, 2, 4)
    assert (m["recall"], m["precision"], m["fret_accuracy"], m["x_error_median"], m["x_error_max"]) == (0.75, 6 / 7, 0.5, 0.0025, 0.008)
    missed = {r.metric for r in match.targets_failed(out).collect()}
    assert {"recall", "precision", "fret_accuracy", "unflagged_frac", "x_error_max", "flag_rate"} == missed


def test_empty_metrics_are_null_and_miss(spark):
    _, out = measure(spark, [], [])
    assert out.first()["recall"] is None and match.targets_failed(out).count() == 7


def test_tolerance_edge_and_nearest_first(spark):
    pairs, _ = measure(spark, [(1, 0, 100.0, 1)], [(1, 0, 110.0, 1, False)])
    assert pairs.count() == 1
    pairs, _ = measure(spark, [(1, 0, 100.0, 1)], [(1, 0, 110.5, 1, False)])
    assert pairs.count() == 0
    pairs, _ = measure(spark, [(1, 0, 100.0, 1), (1, 1, 104.0, 1)], [(1, 0, 103.0, 1, False), (1, 1, 95.0, 1, False)])
    assert {(r.i, r.j) for r in pairs.collect()} == {(1, 0), (0, 1)}


def test_greedy_against_loops(spark):
    rng = random.Random(1)
    truth = [(1, k, float(rng.randrange(300)), 1) for k in range(120)]
    pred = [(1, k, float(rng.randrange(300)), 1, False) for k in range(120)]
    pairs, _ = measure(spark, truth, pred, 400.0)
    used, want = (set(), set()), set()
    for dx, i, j in sorted((abs(t[2] - p[2]), t[1], p[1]) for t in truth for p in pred if abs(t[2] - p[2]) <= 4):
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.add((i, j))
    assert {(r.i, r.j) for r in pairs.collect()} == want


def test_time_grid(spark):
    df = spark.createDataFrame([(30000 / 1001, 1828)], "fps double, n long")
    rows = ordered.time_grid(df, F.col("fps"), F.col("n"), 12).collect()
    assert len(rows) == 732 and rows[12].frame == 30 and len({r.frame for r in rows}) == 732


@pytest.mark.parametrize("n, sizes", [(163, [33, 33, 33, 32, 32]), (40, [40]), (0, [])])
def test_near_even_groups(spark, n, sizes):
    df = spark.range(n).withColumn("k", F.lit(1))
    out = ordered.near_even_groups(df, ["k"], ["id"], 40).groupBy("grid").count().orderBy("grid").collect()
    assert [r["count"] for r in out] == sizes


def test_row_cuts(spark):
    def cuts(bars, xs, end, width):
        df = spark.createDataFrame([(1, bars, xs, end)], "k int, bars array<double>, notes array<double>, e double")
        return [(r.x0, r.x1, r.split) for r in ordered.cut_rows(df, ["k"], "bars", "notes", "e", width).orderBy("r").collect()]

    assert cuts([0.0, 500.0, 1000.0, 1900.0, 2500.0], [], 3000.0, 1920.0) == [(0.0, 1900.0, False), (1900.0, 3000.0, False)]
    assert cuts([0.0], [1800.0, 2000.0], 2600.0, 1920.0) == [(0.0, 1900.0, True), (1900.0, 2600.0, False)]
    assert cuts([], [], 25.0, 10.0) == [(0.0, 10.0, True), (10.0, 20.0, True), (20.0, 25.0, False)]


def test_leave_one_out(spark):


    rng = random.Random(2)
    rows = [(c, k, [float(rng.randrange(9)) for _ in range(3)]) for c in range(6) for k in range(c + 1)]
    out = vectors.leave_one_out_medians(spark.createDataFrame(rows, "c int, k int, v array<double>"), "c", "k", "v").collect()
    for r in out:
        others = [v[r.pos] for c, k, v in rows if c == r.c and k != r.k]
        assert r.loo == (statistics.median(others) if others else None)


def test_residual(spark):
    df = spark.createDataFrame([(1, [], []), (2, [100.0], []), (3, [100.0, 300.0], [101.0, 299.5])], "k int, a array<double>, b array<double>")
    got = {r.k: (r.state, r.residual) for r in vectors.nearest_residual(df, ["k"], "a", "b").collect()}
    assert got == {1: ("none", None), 2: ("one side", None), 3: ("both", 1.0)}


def test_first_decision(spark):
    rows = [(3, True, 3), (0, True, 0), (3, True, 4), (3, True, None), (None, True, None), (None, False, None), (None, True, 3)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m int, v boolean, t int")
    got = [r.d for r in df.select("k", decide.first_decision("m", "v", "t").alias("d")).orderBy("k").collect()]
    assert got == ["verified", "verified", "reread", "reread", "ignored", "reread", "reread"]


def test_digits_must_fit(spark):
    df = spark.createDataFrame([(0, 12, 2), (1, 12, 1), (2, 7, 1)], "k int, m int, n int").selectExpr("*", "true AS v", "m AS t")
    assert [r.d for r in df.select("k", decide.first_decision("m", "v", "t", "n").alias("d")).orderBy("k").collect()] == ["verified", "reread", "verified"]


def test_final_decision(spark):
    """Only an agreement with the template verifies; the first reading there is is shown."""
    rows = [(3, 4, 4, True), (3, 4, 3, True), (3, None, 3, True), (3, 4, None, True), (3, 4, 4, False), (None, None, None, True), (None, 5, 0, True), (3, 4, 4, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m int, t int, r int, v boolean")
    status, fret, reason = decide.final_decision("m", "t", "r", "v")
    got = [tuple(r) for r in df.orderBy("k").select(status, fret, reason).collect()]
    assert got == [("verified_reread", 4, None), ("flagged", 3, decide.DISAGREES), ("flagged", 3, decide.NO_TEMPLATE), ("flagged", 4, decide.DISAGREES), ("flagged", 4, decide.BAD_REREAD),
                   ("flagged", None, decide.NO_TEMPLATE), ("flagged", 0, decide.DISAGREES), ("flagged", 4, decide.BAD_REREAD)]


def test_rounds_match_like_the_greedy(spark):
    """Rounds of mutual firsts against one walk over all sorted pairs, chains and ties included."""
    rng = random.Random(12)
    truth = [(k % 3, k, float(rng.randrange(120))) for k in range(150)] + [(9, 1000 + k, 2.0 * k) for k in range(40)]
    pred = [(k % 3, k, float(rng.randrange(120))) for k in range(150)] + [(9, 1000 + k, 2.0 * k + 1 + k / 100) for k in range(40)]
    want, used = set(), set()
    for c in (0, 1, 2, 9):
        for _, i, j in sorted((abs(x - y), i, j) for a, i, x in truth if a == c for b, j, y in pred if b == c and abs(x - y) <= 5):
            if ("i", i) not in used and ("j", j) not in used:
                used |= {("i", i), ("j", j)}
                want.add((c, i, j))
    got = match.match_pairs(spark.createDataFrame(truth, "c int, i int, x double"), spark.createDataFrame(pred, "c int, j int, x double"), ["c"], 5.0)
    assert {(r.c, r.i, r.j) for r in got.collect()} == want


def test_ranked_median(spark):
    rng = random.Random(2)
    rows = [(k % 7, float(rng.randrange(6))) for k in range(100)] + [(8, None), (9, 2.0)]
    df = spark.createDataFrame(rows, "c int, v double")
    want = {c: statistics.median(v for k, v in rows if k == c and v is not None) for c in {k for k, v in rows if v is not None}}
    assert {r.c: r["median"] for r in ordered.ranked_median(df, ["c"], "v").collect()} == want
    assert ordered.ranked_median(df, [], "v").first()["median"] == statistics.median(v for _, v in rows if v is not None)


def test_fret_text(spark):
    df = spark.createDataFrame([("05",), ("25",), ("24",), ("0",), ("1?",)], "t string")
    assert [r[0] for r in df.select(decide.fret_of("t", 24)).collect()] == [None, None, 24, 0, None]


def test_unknown_price_fails(spark):
    calls = spark.createDataFrame([("x", 1, 1)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("y", 1.0, 1.0)], "model string, input_price double, output_price double")
    with pytest.raises(Exception, match="no price"):
        decide.token_cost(calls, prices, "model").collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def even_starts(xs, tol, size=6):
    out, i = [], 0
    while i + size <= len(xs):
        s = (xs[i + size - 1] - xs[i]) / (size - 1)
        fits = lambda a, b: abs(b - a - s) <= tol * s
        inside = all(fits(xs[k], xs[k + 1]) for k in range(i, i + size - 1))
        if inside and not (i and fits(xs[i - 1], xs[i])) and not (i + size < len(xs) and fits(xs[i + size - 1], xs[i + size])):
            out.append(i)
            i += size
        else:
            i += 1
    return out


def test_even_groups_against_loop(spark):
    rng = random.Random(11)
    keys = {}
    for k in range(60):
        x, xs = 0.0, []
        for _ in range(rng.randrange(0, 60)):
            xs.append(x)
            x += rng.choice((10, 10, 10, 10, 11, 14, 30))
        keys[k] = xs
    rows = [(k, i, x) for k, xs in keys.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x double")
    for tol in (0.15, 0.5):
        got = {(r.k, r.pos) for r in ordered.even_groups(df, ["k"], "x", "i", tol).collect()}
        assert got == {(k, i) for k, xs in keys.items() for i in even_starts(xs, tol)} and got
    seven = spark.createDataFrame([(0, i, 10.0 * i) for i in range(7)], "k int, i int, x double")
    assert ordered.even_groups(seven, ["k"], "x", "i", 0.15).count() == 0
    assert ordered.even_groups(seven.limit(0), ["k"], "x", "i", 0.15).count() == 0


def test_merge_similar_against_loop(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for k in range(8):
        base = rng.normal(size=12)
        for i in range(40):
            if rng.random() < 0.15:
                base = rng.normal(size=12)
            rows.append((k, i, (base + rng.normal(size=12) * 0.5).tolist()))
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    want = set()
    for k in range(8):
        runs = []
        for _, i, v in (r for r in rows if r[0] == k):
            v = np.array(v)
            if runs:
                held = runs[-1]
                picks = held if len(held) <= 5 else [held[round(j * (len(held) - 1) / 4)] for j in range(5)]
                if np.corrcoef(np.median([p[1] for p in picks], axis=0), v)[0, 1] >= 0.7:
                    held.append((i, v))
                    continue
            runs.append([(i, v)])
        want |= {(k, r[0][0], r[-1][0], len(r)) for r in runs}
    got = {tuple(r) for r in vectors.merge_similar(df, ["k"], "i", "v", 0.7, 5).collect()}
    assert got == want and 8 < len(got) < 300
    assert vectors.merge_similar(df.limit(0), ["k"], "i", "v", 0.7).count() == 0
