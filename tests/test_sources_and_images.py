"""Images, validated tables, the manifest and the streaming runs."""

import json
import random

import duckdb
import numpy as np

from notegrid.operators import image
from notegrid.plans import manifest
from notegrid.plans.catalogue import SQL
from notegrid.sources import tables


def flood(ink):
    seen, out = np.zeros_like(ink), []
    for y, x in zip(*np.nonzero(ink)):
        if not seen[y, x]:
            seen[y, x] = True
            todo, box = [(y, x)], [x, y, x, y]
            while todo:
                a, b = todo.pop()
                box = [min(box[0], b), min(box[1], a), max(box[2], b), max(box[3], a)]
                for c in range(max(0, a - 1), min(ink.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(ink.shape[1], b + 2)):
                        if ink[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            out.append(tuple(int(v) for v in box))
    return sorted(out)


def test_components():
    rng = np.random.default_rng(1)
    for density in (0.1, 0.3, 0.5, 0.9):
        ink = rng.random((25, 30)) < density
        assert image.components_of(ink) == flood(ink)
    assert image.components_of(np.zeros((3, 3), bool)) == []


def test_lines_and_medians():
    ink = np.zeros((9, 5), bool)
    ink[4] = True
    ink[2:7, 2] = True
    free = image.without_lines(ink, [(4, 4)])
    assert free[4].tolist() == [False, False, True, False, False] and free[3, 2]
    a, b = np.full((2, 2), 10, np.uint8), np.full((2, 2), 13, np.uint8)
    assert image.median_of([a, b]).tolist() == [[11, 11], [11, 11]]
    gray = np.full((10, 10), 250, np.uint8)
    gray[3:5, 2:4] = 20
    assert image.ink_of(gray).sum() == 4


def test_image_tables(spark):
    gray = np.full((6, 8), 255, np.uint8)
    gray[1:3, 1:3] = 0
    gray[4, 5:8] = 0
    rows = [("a", k, 0, 6, 8, bytearray(gray.tobytes())) for k in range(3)]
    df = spark.createDataFrame(rows, "video_id string, k int, page int, h int, w int, px binary")
    assert {tuple(r)[2:] for r in image.marks(df).collect()} == {(1, 1, 2, 2), (5, 4, 7, 4)}
    assert bytes(image.page_medians(df).first().px) == gray.tobytes()


def test_tabs(spark, tmp_path):
    good = {"video_id": "v", "tab_width_px": 1000, "notes": [{"id": 0, "string": 1, "x": 5.0, "fret": 3, "status": "verified"}, {"id": 1, "string": 6, "x": 7, "fret": None, "status": "flagged"}]}

    def with_note(**change):
        return good | {"video_id": str(change), "notes": [good["notes"][0] | change]}

    cases = {"good": good, "string": with_note(string=7), "fret": with_note(fret=25), "status": with_note(status="maybe"), "null": with_note(fret=None), "width": good | {"tab_width_px": 0}}
    for name, doc in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = {r.video_id: r.refused for r in tables.read_tabs(spark, str(tmp_path / "*.json"), True).where("tab_width_px > 0").collect()}
    assert got == {"v": None, "{'string': 7}": "note", "{'fret': 25}": "fret", "{'status': 'maybe'}": "status", "{'fret': None}": "null fret is not flagged"}
    assert tables.tab_notes(tables.read_tabs(spark, str(tmp_path / "*.json"))).count() == 2


def test_members_of_tabs(spark, tmp_path):
    """Unknown and missing members are seen, at the top and in notes; whole and broken numbers are told apart."""
    note = {"string": 1, "x": 5, "fret": 3}
    doc = lambda *notes, **more: {"video_id": "v", "tab_width_px": 1000, "notes": list(notes)} | more
    cases = [(doc(note), None), (doc(note, other=1), "unknown member"), (doc(note | {"y": 1}), "note"), (doc({"string": 1, "x": 5}), "note"), (doc({"string": 1.5, "x": 5, "fret": 3}), "note"),
             (doc(note | {"fret": "3"}), "fret"), (doc(note | {"x": "5"}), "note"), (doc(note | {"id": -1}), "note"), (doc(note | {"readers": {"model": 3, "eye": 3}}), "readers"), ([], "unknown member"), (doc(video_id=""), "required")]
    for k, (text, _) in enumerate(cases):
        (tmp_path / f"{k:02d}.json").write_text(json.dumps(text))
    got = {}
    for k in range(len(cases)):
        got[k] = tables.read_tabs(spark, f"{tmp_path}/{k:02d}.json").first().refused
    assert got == {k: reason for k, (_, reason) in enumerate(cases)}


def test_videos(spark, tmp_path):
    """Raw videos from files, cut ones and others included."""
    from notegrid.sources import videos

    frame = lambda k: b"FRAME Ip\n" + bytes([k] * 12) + bytes([128] * 6)
    head = b"YUV4MPEG2 W4 H3 F25:2 Ip A1:1 C420mpeg2\n"
    (tmp_path / "a.y4m").write_bytes(head + b"".join(map(frame, range(5))))
    (tmp_path / "b.y4m").write_bytes(head + frame(7) + frame(8)[:-1])
    (tmp_path / "c.y4m").write_bytes(b"RIFF")
    (tmp_path / "d.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F1:1 Cmono\n" + b"FRAME\n" + bytes(4))
    files = videos.video_files(spark, f"{tmp_path}/*.y4m")
    got = {r.video_id: tuple(r)[1:] for r in videos.probe(files).collect()}
    assert got == {"a": (4, 3, 12.5, 5, None), "b": (4, 3, 12.5, 1, None), "c": (None, None, None, 0, "unreadable"), "d": (2, 2, 1.0, 1, None)}
    wanted = spark.createDataFrame([(v, f) for v in "abcd" for f in (3, 0, 3)], "video_id string, frame long")
    frames = {(r.video_id, r.frame): (r.refused, r.px and bytes(r.px)) for r in videos.read_frames(files, wanted).collect()}
    assert frames == {("a", 0): (None, bytes(12)), ("a", 3): (None, bytes([3] * 12)), ("b", 0): (None, bytes([7] * 12)), ("b", 3): ("ended early", None), ("c", 0): ("unreadable", None), ("d", 0): (None, bytes(4)), ("d", 3): ("ended early", None)}


def test_pdf():
    """Every object lies where the table of a sheet says, and texts are escaped."""
    from notegrid.operators.layout import LETTER
    from notegrid.sources import drawing

    page = drawing.page_operators([(0, 36.0, 576.0), (1, 36.0, 300.0)], [("12", 100.0, 700.0, True), ("?", 120.0, 693.0, False)], [(0, 50.0)], ("a(b", "1 of 2"), LETTER)
    assert page.count(" l S") == 13 and "(a\\(b) Tj" in page and page.count("0.85 0 0 rg") == 1
    pdf = drawing.pdf_bytes([page, ""], 612, 792)
    start = int(pdf.rpartition(b"startxref\n")[2].split()[0])
    table = pdf[start:].split(b"trailer")[0].split(b"\n")[3:-1]
    assert len(table) == 7 and all(pdf[int(x[:10]):].startswith(f"{k + 1} 0 obj".encode()) for k, x in enumerate(table))


def test_pictures_for_the_eye(spark):
    from notegrid.sources import drawing

    gray = np.full((6, 8), 90, np.uint8)
    assert drawing.framed(gray, [(2, 2, 3, 3)]).tolist()[1] == [90, 0, 0, 0, 0, 90, 90, 90]
    assert drawing.dimmed(gray, (1, 1, 2, 2))[1].tolist() == [30, 90, 90, 30, 30, 30, 30, 30]
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.01)], "k int, v double")
    from pyspark.sql import functions as F

    assert [r.y for r in df.select("k", drawing.decade_place(F.col("v"), 9).alias("y")).orderBy("k").collect()] == [8, 0, 4]
    (plot,) = drawing.plots(df.withColumn("video_id", F.lit("a")), ["video_id"], "k", "v", 0.1, 9).collect()
    assert bytes(plot.png).startswith(b"\x89PNG")


def test_calls_and_manifest(spark):
    wanted = tables.call_keys(spark.createDataFrame([("p1", "read", 1), ("p2", "read", 1)], "png string, role string, attempt int"), "png", "role", "attempt")
    key = wanted.where("png = 'p1'").first().key
    cache = spark.createDataFrame([(key, 1, False, "bad"), (key, 2, True, "fine"), (key, 3, True, "later")], "key string, attempt int, valid boolean, response string")
    got = {r.png: (r.new, r.response) for r in tables.cached_calls(wanted.drop("attempt"), cache).collect()}
    assert got == {"p1": (False, "fine"), "p2": (True, None)}
    inputs = spark.createDataFrame([("v", "rows", "b", "2"), ("v", "rows", "a", "1"), ("w", "rows", "a", "1")], "video_id string, stage string, name string, content string")
    params = spark.createDataFrame([("rows", 1, "{}")], "stage string, version int, params string")
    keys = manifest.stage_keys(inputs, params)
    assert keys.select("key").distinct().count() == 2 and manifest.stale(keys, keys).count() == 0
    newer = manifest.stage_keys(inputs, spark.createDataFrame([("rows", 2, "{}")], params.schema))
    assert manifest.stale(newer, keys).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from notegrid.operators.ordered import anchored_runs
    from notegrid.streaming.runs import anchored_runs_stream

    rng = random.Random(3)
    rows = [(k, k % 3, rng.random() * 200) for k in range(200)]
    batch = spark.createDataFrame([(i, u, i * 1.0, v) for i, u, v in rows], "event_id long, user_id long, ts double, value double")
    for part in range(4):
        batch.where(f"event_id DIV 50 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = anchored_runs_stream(stream, 60, 90).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = {tuple(r) for r in spark.sql("SELECT user_id, i0, i1, n FROM runs").collect()}
    every = {(r.user_id, r.i0, r.i1, r.n) for r in anchored_runs(batch, ["user_id"], "ts", "event_id", "value", 60, 90).collect()}
    last = {max((r for r in every if r[0] == u), key=lambda r: r[2]) for u in range(3)}
    assert got == every - last


def test_inputs(spark, tmp_path):
    from notegrid.sources import inputs

    sources = {"https://youtu.be/abcdefghijk": "abcdefghijk", "https://www.youtube.com/shorts/ABC-_efghij?x=1": "ABC-_efghij", "http://h/embed/abcdefghij": None,
               "a/b.c/take.two.mp4": "take.two", "take": "take", ".hidden": ".hidden", "/x/clip.mp4/": "clip"}
    df = spark.createDataFrame([(k,) for k in sources], "source string")
    assert {r.source: r.id for r in df.select("source", inputs.video_id("source").alias("id")).collect()} == sources
    crops = {"0,0,1920,484": (0, 0, 1920, 484), " 1 ,+2,3, 4": (1, 2, 3, 4), "-1,0,5,5": None, "0,0,5,0": None, "1,2,3": None, "1,2,3,4,5": None, "1.0,2,3,4": None, "": None, "99999999999,0,1,1": None}
    df = spark.createDataFrame([(k,) for k in crops], "c string")
    assert {r.c: r.a and tuple(r.a) for r in df.select("c", inputs.crop_of("c").alias("a")).collect()} == crops
    (tmp_path / "v2.args").write_text("--crop 0,0,1920,484 --layout 'paged-strip'\n")
    (tmp_path / "v1.args").write_text("--layout 'a b'")
    assert [tuple(r) for r in inputs.read_args(spark, f"{tmp_path}/*.args").collect()] == [("v1", ["--layout", "a b"]), ("v2", ["--crop", "0,0,1920,484", "--layout", "paged-strip"])]


def test_jobs_of_one_source(spark):
    """Two jobs of one URL and two files of one video: a job is one row, a source one download."""
    from notegrid.sources import videos

    url, file = "https://youtu.be/abcdefghijk", "clips/take.y4m"
    jobs = spark.createDataFrame([(1, url), (2, url), (3, file), (4, file)], "job int, source string")
    found = videos.located(jobs, spark.createDataFrame([("take", "/b/take"), ("take", "/a/take")], "video_id string, path string"))
    assert sorted((r.job, r.path, r.fetch, r.refused) for r in found.collect()) == [(1, None, True, None), (2, None, True, None), (3, "/a/take", False, None), (4, "/a/take", False, None)]
    assert [(r.video_id, bytes(r.content)) for r in videos.fetched(found, str.encode).collect()] == [("abcdefghijk", url.encode())]


def test_job_sources_of_long_keys(spark, tmp_path):
    """Keys of seven digits and more, which a name of six would not tell apart."""
    from notegrid.plans import catalogue_flow

    keys = [5, 100_000, 100_001, 1_000_000, 1_000_001, 1_000_002, 1_000_009, 1_000_015, 2 ** 62 + 1]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    theirs = db.execute(SQL["job_sources"])
    names = [d[0] for d in theirs.description]
    got = catalogue_flow.QUERIES["job_sources"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, theirs.fetchall()))
