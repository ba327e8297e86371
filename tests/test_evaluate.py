"""Evaluation of whole tables, by hand."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notegrid.plans.evaluate import evaluate
from notegrid.sources import tables


def note(string, x, fret, status=None, k=None):
    return {"string": string, "x": x, "fret": fret} | ({"status": status} if status else {}) | ({"id": k} if k is not None else {})


def tab(name, notes, width=1000.0):
    return {"video_id": name, "tab_width_px": width, "notes": notes}


@pytest.fixture
def load(spark, tmp_path):
    def write(side, docs, prediction):
        folder = tmp_path / side
        folder.mkdir()
        for k, d in enumerate(docs):
            (folder / f"{k}.json").write_text(json.dumps(d))
        return tables.read_tabs(spark, f"{folder}/*.json", prediction)

    return write


def test_evaluate(load):
    true = [note(1 + k % 3, 100.0 * (k + 1), k) for k in range(10)]
    same = [n | {"status": "verified"} for n in true]
    shifted = [n | {"x": n["x"] + 5} for n in same]
    # 5 hits, one with a flagged wrong fret; 5 misses; a plain extra and a flagged one
    mixed = same[:4] + [note(2, 503.0, 9, "flagged"), note(4, 50.0, 1, "verified"), note(1, 980.0, 2, "flagged")]
    docs = {"perfect": (true, same), "shifted": (true, shifted), "mixed": (true, mixed), "silent": ([], []), "unheard": (true, []),
            "edge": ([note(1, 100.0, 3), note(2, 100.0, 3)], [note(1, 110.0, 3, "verified"), note(2, 110.5, 3, "verified")]),
            "nearest": ([note(1, 100.0, 3), note(1, 106.0, 4)], [note(1, 105.0, 4, "verified"), note(1, 99.0, 3, "verified")])}
    truth = load("truth", [*(tab(n, t) for n, (t, _) in docs.items()), tab("wide", true, 900.0), tab("alone", true), tab("bad", [note(7, 1.0, 1)])], False)
    pred = load("pred", [*(tab(n, p) for n, (_, p) in docs.items()), tab("wide", same), tab("bad", same), tab("extra", same)], True)
    got = {r.video_id: r for r in evaluate(truth, pred).collect()}
    assert {n: r.refused for n, r in got.items() if r.refused} == {"wide": "widths", "alone": "no prediction", "extra": "no truth", "bad": "truth: note"}
    assert set(got) == {*docs, "wide", "alone", "extra", "bad"} and {n for n, r in got.items() if r.passed} == {"perfect", "nearest"}
    assert (got["perfect"].recall, got["perfect"].precision, got["perfect"].x_error_max, got["perfect"].failed) == (1, 1, 0, [])
    assert got["shifted"].failed == ["x_error_median"] and got["shifted"].x_error_max == 0.005
    m = got["mixed"]
    assert (m.matched, m.missing, m.extra, m.wrong_fret, m.flagged, m.flagged_errors, m.unflagged_errors) == (5, 5, 2, 1, 2, 2, 6)
    assert (m.recall, m.precision, m.fret_accuracy, m.unflagged_frac, m.x_error_median, m.x_error_max) == (0.5, 5 / 7, 0.8, 0.6, 0.0, 0.003)
    assert m.flag_rate == 2 / 7 and m.flag_precision == 1.0
    assert got["silent"].recall is None and len(got["silent"].failed) == 7
    assert (got["unheard"].recall, got["unheard"].precision, got["unheard"].missing) == (0, None, 10)
    assert (got["edge"].matched, got["edge"].missing, got["edge"].extra) == (1, 1, 1)
    assert (got["nearest"].matched, got["nearest"].wrong_fret) == (2, 0) and got["nearest"].x_error_max == 0.001


def test_order_of_notes(load):
    """Lists that come in another order each time they are made, as after a shuffle."""
    true = [note(1 + k % 3, 100.0 * (k + 1), k % 20) for k in range(60)]
    kind = "array<struct<id: int, string: int, x: double, fret: int, status: string>>"

    @F.pandas_udf(kind)
    def dealt(notes: pd.Series) -> pd.Series:
        return notes.map(lambda a: [a[k] for k in np.random.default_rng().permutation(len(a))])

    made = lambda side: load(side, [tab("v", [n | {"status": "verified"} for n in true], 10_000.0)], True)
    some = lambda df: df.withColumn("notes", F.transform("notes", lambda n: F.struct(n["id"], n["string"], n["x"], n["fret"], n["status"])).cast(kind))
    mixed = lambda df: some(df).withColumn("notes", dealt.asNondeterministic()("notes"))
    (got,) = evaluate(mixed(made("truth")), mixed(made("pred"))).collect()
    assert (got.matched, got.missing, got.extra, got.wrong_fret, got.x_error_max, got.passed) == (60, 0, 0, 0, 0.0, True)
