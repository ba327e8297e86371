"""Queries over the read stage, the runner, sources, sinks and layouts: an event
is a note, its user a video; suppliers, nations and parts are videos, too."""

from __future__ import annotations

from base64 import urlsafe_b64decode
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.config import Thresholds
from notegrid.operators import decide, layout, ordered
from notegrid.plans import evaluate as evaluation
from notegrid.plans import manifest, reading, runner
from notegrid.sources import drawing, inputs, sinks, tables, videos
from notegrid.sources.shared import new_path

QUERIES: dict = {}
KEY = ["video_id", "id"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(k, *texts):
    """The text of place ``k``."""
    return F.get(F.array(*[F.lit(t) for t in texts]), k.cast("int"))


# --- the read stage ---

def _notes(spark, sf_dir):
    e, level = table(spark, sf_dir, "events"), F.floor("value").cast("int")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), (1 + F.col("event_id") % 6).cast("int").alias("string"), (F.col("event_id") % 997).cast("double").alias("x"),
                    (1 + F.col("event_id") % 2).cast("int").alias("digits"), (level % 25).alias("own"))


def _finished(spark, sf_dir):
    notes, k = _notes(spark, sf_dir), F.col("id")
    model = notes.where(k % 13 != 0).select(*KEY, F.when(k % 7 != 0, F.col("own")).alias("fret"), (k % 11 != 0).alias("valid"))
    template = notes.select(*KEY, F.when(k % 5 == 0, None).when(k % 3 == 0, F.col("own")).otherwise(k % 25).cast("int").alias("fret"))
    first = reading.decided(notes, model, template)
    wanted = reading.to_reread(first).join(notes.select(*KEY, "own"), KEY)
    again = wanted.select(*KEY, F.when(k % 4 == 0, None).when(k % 4 == 1, F.col("own")).otherwise(k % 25).cast("int").alias("fret"), (k % 6 != 0).alias("valid")).where(k % 17 != 0)
    return reading.finished(first, again)


@query
def read_stage(spark, sf_dir):
    return _finished(spark, sf_dir).select(*KEY, "first", "status", "fret", "reason")


@query
def read_counts(spark, sf_dir):
    return reading.counts(_finished(spark, sf_dir), ["video_id"])


@query
def final_notes(spark, sf_dir):
    out = reading.final_notes(_finished(spark, sf_dir))
    return out.select(*KEY, "fret", decide.fret_text("fret").alias("text"), "status", "readers.model", "readers.template", "readers.reread")


@query
def tab_documents(spark, sf_dir):
    done = _finished(spark, sf_dir)  # every mark of some videos is ignored
    notes = reading.final_notes(done.withColumn("status", F.when(F.col("video_id") % 50 == 0, "ignored").otherwise(F.col("status"))))
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    origin = (F.col("video_id") % 9).cast("double")
    rows = every.select("video_id", origin.alias("origin_x"), F.array(F.lit(0), F.lit(900)).alias("extent"), F.lit(10.0).alias("s"), F.array(*[F.lit(10.0 * k) for k in range(6)]).alias("line_y"), F.array(origin, origin + 100).alias("bar_x"))
    out = reading.assembled(notes, rows, every.withColumn("tab_width_px", F.lit(900.0)))
    return out.select("video_id", F.size("notes").alias("n"), F.col("notes")[0]["id"].alias("first_id"), F.array_join(F.transform("row.bar_x", lambda b: b.cast("int").cast("string")), ",").alias("bars"), "refused")


@query
def sheet_headers(spark, sf_dir):
    return reading.headers(reading.final_notes(_finished(spark, sf_dir)), ["video_id"])


@query
def call_costs(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("role"), (F.col("l_linestatus") == "O").alias("new"), F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long")).alias("output_tokens"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("input_price"), F.col("p_size").alias("output_price"))
    return reading.costs(calls, prices, ["role"])


FOUR = Thresholds(max_cells=4)


@query
def note_grids(spark, sf_dir):
    """The lists of both reads in one table (SET-4)."""
    first = reading.grids(_notes(spark, sf_dir), FOUR).withColumn("role", F.lit("read"))
    again = reading.grids(reading.to_reread(_finished(spark, sf_dir)), FOUR).withColumn("role", F.lit("reread"))
    both = first.unionByName(again)
    return both.select("role", "video_id", "grid", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query
def grid_chain(spark, sf_dir):
    """Notes to grids to keys to recorded answers and back to notes (RED-1)."""
    grids = reading.grids(_notes(spark, sf_dir), FOUR)
    wanted = reading.attempts(grids.withColumn("png", F.to_json("ids")).withColumn("role", F.lit("read")), "png", "role")
    said = F.to_json(F.struct(F.transform("ids", lambda i: F.struct(i.alias("id"), (i % 25).cast("int").alias("fret"))).alias("notes")))
    part = F.array(F.struct(said.alias("text")))
    good = F.to_json(F.struct(F.array(F.struct(F.lit("STOP").alias("finish_reason"), F.struct(part.alias("parts")).alias("content"))).alias("candidates")))
    turn, bad = F.col("attempt"), F.lit('{"candidates": []}')
    first = F.element_at("ids", 1)
    cache = wanted.where(~((first % 5 == 4) & (turn == 1))).select("key", F.when((first % 3 == 0) & (turn == 0), bad).when((first % 5 == 3) & (turn == 1), bad).when((first % 6 == 0) & (turn == 1), bad).otherwise(good).alias("response"))
    return reading.readings(grids, wanted.select("video_id", "grid", "attempt", "key"), cache, FOUR)


def _answer(row: dict) -> str:
    return f"answer to {row['p_partkey']}"


@query
def asked_calls(spark, sf_dir):
    wanted = tables.call_keys(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return reading.asked(wanted.drop("p_name"), wanted.where("p_partkey % 3 = 0"), _answer).select("p_partkey", "response")


@query
def cached_lookup(spark, sf_dir):
    k = F.col("o_orderkey")
    calls = tables.call_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit("read").alias("role")), "o_orderkey", "role", "o_orderpriority")
    cache = calls.where(k % 4 != 0).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).select("key", "attempt", F.when(F.col("attempt") == 0, k % 4 == 1).otherwise(k % 4 == 2).alias("valid"), F.concat(F.lit("r"), F.col("attempt").cast("string")).alias("response"))
    return tables.cached_calls(calls, cache).select("o_orderkey", F.col("key"), "new", "attempt", "valid", "response")


@query
def reading_maps(spark, sf_dir):
    made = decide.by_id(_notes(spark, sf_dir), ["video_id"], "id", "own")
    return made.select("video_id", F.size("readings").alias("n"), F.coalesce(F.try_element_at("readings", F.col("video_id")), F.lit(-1)).alias("own_id"))


# --- keys and the runner ---

@query
def stage_key_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    given = docs.select(F.coalesce("source", F.lit("none")).alias("video_id"), F.lit("rows").alias("stage"), F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    params = spark.createDataFrame([("rows", 3, '{"a": 1}')], "stage string, version int, params string")
    return manifest.stage_keys(given, params)


def _inputs(path: str, spark: SparkSession, root: str, videos: DataFrame) -> DataFrame:
    return spark.read.schema("video_id STRING, name STRING, content STRING").parquet(path)


def _ran(out: str, refuse: int, spark: SparkSession, root: str, videos: DataFrame) -> DataFrame:
    number = F.col("video_id").cast("int")
    told = videos.withColumn("refused", F.when(number % refuse == 1, "bad input"))
    told.where("refused IS NULL").write.mode("append").parquet(runner.stage_path(root, out))
    return told


@query
def stage_runs(spark, sf_dir):
    """Two stages run three times: a first run, one with some inputs changed,
    and one stage alone by force (CTL-1, CTL-2, SNK-6)."""
    root, out = new_path(spark, "workspace"), None
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("video_id"), F.col("n_name").alias("content"), "n_nationkey")
    for turn in range(3):
        path = f"{root}/inputs-{turn}"
        changed = F.when((F.lit(turn) > 0) & (F.col("n_nationkey") % 4 == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
        nations.select("video_id", F.lit("clip").alias("name"), changed.alias("content")).write.parquet(path)
        stages = [runner.Stage("ingest", 1, "{}", partial(_inputs, path), partial(_ran, "ingest", 5)), runner.Stage("rows", 1, "{}", partial(_inputs, path), partial(_ran, "rows", 7))]
        for result in runner.run_all(spark, stages, root, nations.select("video_id"), only="rows" if turn == 2 else None):
            result = result.withColumn("turn", F.lit(turn))
            out = result if out is None else out.unionByName(result)
    return out


# --- evaluation and reports ---

def _documents(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    note = lambda x, fret, status: F.struct(F.lit(None).cast("int").alias("id"), (1 + k % 6).cast("int").alias("string"), x.cast("double").alias("x"), fret.cast("int").alias("fret"), status.alias("status"))
    none, place = F.lit(None).cast("string"), 100 * k
    true = p.where("p_size % 11 <> 0").groupBy("p_size").agg(F.collect_list(note(place, k % 25, none)).alias("notes"))
    flag = F.when(k % 8 == 0, "flagged").otherwise("verified")
    shifted = F.array(*[F.when(k % 7 != 0, note(place + k % 3, F.when(k % 9 == 0, 24).otherwise(k % 25), flag)), F.when(k % 5 == 0, note(place + 50, k % 25, flag))])
    pred = p.where("p_size % 13 <> 0").groupBy("p_size").agg(F.flatten(F.collect_list(F.array_compact(shifted))).alias("notes"))
    named = lambda df, width, refused: df.select(F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("video_id"), width.cast("double").alias("tab_width_px"), "notes", refused.alias("refused"))
    return named(true, F.lit(1000), F.when(F.col("p_size") % 17 == 0, "note")), named(pred, F.when(F.col("p_size") % 10 == 0, 900).otherwise(1000), none), name


@query
def evaluated(spark, sf_dir):
    truth, pred, _ = _documents(spark, sf_dir)
    out = evaluation.evaluate(truth, pred)
    return out.select("video_id", "refused", "matched", "missing", "extra", "wrong_fret", "unflagged_errors", "flagged_errors", F.round("recall", 6).alias("recall"), F.round("x_error_median", 6).alias("x_error_median"), F.round("flag_rate", 6).alias("flag_rate"),
                      F.array_join("failed", ",").alias("failed"), "passed")


@query
def metric_report(spark, sf_dir):
    measured = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 1, 1.0).otherwise(0.0)), 4).alias("recall"), F.lit(None).cast("double").alias("precision"), F.count("*").alias("extra"))
    return sinks.metric_lines(measured, "event_type")


@query
def status_texts(spark, sf_dir):
    return sinks.status_lines(reading.counts(_finished(spark, sf_dir), ["video_id"]), "video_id", ["verified", "flagged", "ignored"])


@query
def escaped_cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sinks.escaped("html").alias("cell"))


# --- files ---

def _faulty(k):
    """A document's text of one of the faults 1 to 11, else a good one."""
    note = '{"id": 1, "string": 2, "x": 5.5, "fret": 3, "status": "verified", "readers": {"model": 3, "template": null}}'
    row = '"row": {"origin_x": 1, "extent": [0, 9.5], "s": 2.5, "line_y": [1, 2, 3, 4, 5, 6], "bar_x": []}'
    doc = lambda notes=note, more=row, width="10": f'{{"video_id": "v", "tab_width_px": {width}, {more}, "notes": [{notes}]}}'
    return pick(k % 14, doc(), doc(width="0"), doc(note.replace('"x"', '"y"')), doc(note.replace(', "fret": 3', "")), doc(note.replace('"fret": 3', '"fret": 25')), doc(note.replace('"fret": 3', '"fret": null')), doc(more=row.replace("[0, 9.5]", "[0]")),
                doc(more='"other": 1'), doc(note.replace("verified", "maybe")), doc(note.replace('"model": 3', '"model": 31')), "{", doc(note.replace('"string": 2', '"string": "2"')), doc(note.replace('"status": "verified", ', "")), doc(note.replace('"verified"', '"flagged"').replace('"fret": 3', '"fret": null')))


@query
def tab_files(spark, sf_dir):
    """Documents with one fault each, a file each, read and judged (SRC-6, SRC-7, JSN-3)."""
    path, k = new_path(spark, "tabs"), F.col("n_nationkey")
    table(spark, sf_dir, "nation").select("n_nationkey", _faulty(k).alias("value")).write.partitionBy("n_nationkey").text(path)
    read = tables.read_tabs(spark, f"{path}/*/*.txt", prediction=True)
    return read.groupBy("refused").agg(F.count("*").alias("files"), F.sum(F.size("notes")).alias("notes"))


def _tabs(spark, sf_dir, low=0):
    n = table(spark, sf_dir, "nation").where(f"n_nationkey >= {low}")
    note = F.struct(F.lit(0).alias("id"), (1 + F.col("n_nationkey") % 6).alias("string"), F.lit(1.5).alias("x"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey")).alias("fret"), F.lit("flagged").alias("status"), F.lit(None).cast(tables.READERS).alias("readers"))
    return n.select(F.col("n_name").alias("video_id"), (F.col("n_nationkey") + 10.0 + low).alias("tab_width_px"), F.lit(None).cast(tables.ROW).alias("row"), F.array(note).alias("notes"))


@query
def replaced_tabs(spark, sf_dir):
    """Documents written twice: those of the second write replace theirs and no others (SNK-3, SNK-7)."""
    path = new_path(spark, "written")
    sinks.write_tabs(_tabs(spark, sf_dir), path)
    sinks.write_tabs(_tabs(spark, sf_dir, 20), path)
    out = spark.read.schema(tables.TAB).json(path)
    return out.select("video_id", "tab_width_px", F.col("notes")[0]["fret"].alias("fret"))


@query
def draft_rounds(spark, sf_dir):
    """Drafts written for some videos, then for all: those with a truth have none, the others one (SNK-11, PRJ-9)."""
    path, tabs = new_path(spark, "drafts"), _tabs(spark, sf_dir)
    truth = tabs.where("tab_width_px > 30")
    sinks.write_drafts(tabs.where("tab_width_px < 15"), path, truth)
    sinks.write_drafts(tabs.withColumn("tab_width_px", F.col("tab_width_px") + 100), path, truth)
    out = spark.read.schema("video_id STRING, tab_width_px DOUBLE, notes ARRAY<STRUCT<string: INT, x: DOUBLE, fret: INT>>").json(path)
    return out.select("video_id", "tab_width_px", F.col("notes")[0]["string"].alias("string"), F.col("notes")[0]["fret"].alias("fret"))


@query
def recorded_calls(spark, sf_dir):
    """The used calls written as fixtures and read back (SNK-8, SRC-13)."""
    path, k = new_path(spark, "fixtures"), F.col("n_nationkey")
    cache = table(spark, sf_dir, "nation").select(F.format_string("key%d", k).alias("key"), F.lit("read").alias("role"), F.lit("m").alias("model"), (k % 2).alias("attempt"), F.array(k).alias("ids"), F.struct(F.col("n_name").alias("said")).alias("response"))
    sinks.record_calls(cache, cache.where("attempt = 0"), path)
    return tables.read_calls(spark, f"{path}/*/*.json").select("key", "role", "attempt", F.col("ids")[0].alias("first"), "response")


@query
def dated_results(spark, sf_dir):
    path = new_path(spark, "results")
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    sinks.write_results(rows, path)
    out = spark.read.schema("r_regionkey INT, r_name STRING, time STRING, date STRING").json(path)
    return out.select("r_regionkey", "r_name", (F.col("date").cast("date") == F.current_date()).alias("today"), F.col("time").rlike("^[0-9-]{10}T[0-9:]{8}$").alias("timed"))


@query
def argument_files(spark, sf_dir):
    """Jobs' shell-quoted argument files, in order of their names (SRC-9, SRC-10)."""
    path, k = new_path(spark, "arguments"), F.col("n_nationkey")
    text = F.concat(F.lit("--crop 0,0,"), k.cast("string"), F.lit(",9 --layout 'paged strip' "), F.col("n_name"))
    sinks.write_files(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".args")).alias("name"), F.encode(text, "UTF-8").alias("content")), path)
    return inputs.read_args(spark, f"{path}/*.args").select("video_id", F.array_join("args", "|").alias("args"))


@query
def report_pages(spark, sf_dir):
    """A page that needs no other file, its cells escaped (SNK-5, STR-7)."""
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", F.concat(F.lit("<"), "r_name", F.lit(">")).alias("name"), F.lit(None).cast("int").alias("none"), (F.col("r_regionkey") / 2).alias("half"))
    return spark.createDataFrame([(sinks.report_page("A & B", [("Regions", regions)]),)], "page string")


@query
def prompt_digests(spark, sf_dir):
    """A prompt and its schema read from files, and the digest of both (SRC-8, JSN-5)."""
    path = new_path(spark, "prompts")
    spark.createDataFrame([('{"b": 1, "a": [2, {"d": null, "c": "x"}]}',)], "value string").coalesce(1).write.text(f"{path}/schema")
    spark.createDataFrame([("Read the numbers.",)], "value string").coalesce(1).write.text(f"{path}/text")
    text, schema = tables.read_prompt(spark, f"{path}/text/*.txt", f"{path}/schema/*.txt")
    return table(spark, sf_dir, "region").select("r_regionkey", tables.prompt_digest(F.concat(F.lit(text.strip()), "r_name"), F.lit(schema.strip())).alias("digest"))


# --- videos ---

def _files(spark, sf_dir):
    """A raw video a supplier: frames of 4 x 2 luma bytes of their number, then two of chroma."""
    k = F.col("s_suppkey")
    frame = F.transform(F.sequence(F.lit(0), 2 + k % 9), lambda i: F.concat(F.lit("4652414D450A"), F.repeat(F.lpad(F.hex(i), 2, "0"), F.lit(8)), F.lit("8080"), F.lit("8080")))
    head = F.hex(F.concat(F.when(k % 10 == 7, "no video ").otherwise("YUV4MPEG2 "), F.format_string("W4 H2 F%d:1 C420jpeg\n", 2 + k % 3).cast("string")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("video_id"), F.unhex(F.concat(head, F.array_join(F.when(k % 10 == 6, F.slice(frame, 1, 0)).otherwise(frame), ""))).alias("content"), k.alias("key"))


@query
def video_probe(spark, sf_dir):
    return videos.probe(_files(spark, sf_dir))


@query
def frame_scan(spark, sf_dir):
    files = _files(spark, sf_dir)
    wanted = videos.wanted_frames(files.select("video_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(1), F.lit(6))).alias("frame")))
    return videos.read_frames(files, wanted).select("video_id", "frame", "h", "w", F.hex("px").alias("px"), "refused")


@query
def frame_samples(spark, sf_dir):
    """Sample times, their frames read once, every sample with its picture, cropped, written and read (JOI-9, SET-5, SNK-2, SRC-5, PRJ-1)."""
    files, path, k = _files(spark, sf_dir), new_path(spark, "samples"), F.col("key")
    times = ordered.time_grid(files.drop("content"), (2 + k % 3).cast("double"), 3 + k % 9, 3)
    samples = times.select("video_id", "k", "t", "frame")
    both = videos.spread(samples, videos.read_frames(files, videos.wanted_frames(samples)))
    area = F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"))
    videos.write_samples(videos.cropped(both.withColumn("area", area)), path)
    return videos.read_samples(spark, path).select("video_id", "k", "frame", "h", "w", F.hex("px").alias("px"))


def _download(url: str) -> bytes:
    if int.from_bytes(urlsafe_b64decode(url[-11:] + "="), "big") % 10 == 5:
        raise OSError("gone")
    return url.encode()


@query
def job_sources(spark, sf_dir):
    """Local files, sources to fetch and what a download gives or raises (SRC-3,
    SRC-14). A video's id is the eleven characters of its whole key; files have
    short names, which may be the same."""
    k = F.col("p_partkey")
    name = F.translate(F.base64(F.unhex(F.lpad(F.hex(k), 16, "0"))), "+/=", "-_")
    short = F.concat(F.lit("video"), F.lpad(k.cast("string"), 6, "0"))
    jobs = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("clips/"), name, F.lit(".y4m"))).otherwise(F.concat(F.lit("https://youtu.be/"), name)).alias("source"))
    local = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(name.alias("video_id"), F.concat(F.lit("/held/"), short).alias("path"))
    found = videos.located(jobs, local)
    got = videos.fetched(found, _download).select(F.col("path").alias("url"), F.length("content").alias("bytes"), F.col("refused").alias("failed"))
    return found.join(got, F.col("source") == F.col("url"), "left").select("p_partkey", "path", "fetch", "refused", "bytes", "failed")


@query
def output_paths(spark, sf_dir):
    """Where a job's sheet goes (LAY-2): the path of its arguments, else its video's name."""
    k = F.col("p_partkey")
    asked = F.when(k % 4 == 0, F.concat(F.lit("sheets/"), k.cast("string"), F.lit(".pdf")))
    jobs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/take"), k.cast("string"), F.lit(".mp4")).alias("source"), asked.alias("output"))
    return jobs.select("p_partkey", inputs.output_path("source", "output").alias("path"))


# --- geometry and sheets ---

@query
def row_geometry(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array((20 + k % 30).cast("double"), (200 + k % 50).cast("double"))).alias("bar_x"),
                                               F.lit(20).alias("left"), (210 + size).alias("right"), F.lit(12.0).alias("s"), F.array(*[size * 1.5 + 10.0 * i for i in range(6)]).alias("line_y"), (60 + k % 90).alias("height"))
    rows = rows.withColumn("origin", layout.origin_x("bar_x", "left", "s")).withColumn("end", layout.row_end("bar_x", "right", "origin", "s"))
    top, bottom = layout.band("line_y", "s", "height")
    return rows.select("p_partkey", "origin", "end", top.alias("top"), bottom.alias("bottom"))


@query
def shared_bars(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    row = lambda low, high, *bars: F.struct(F.array(low, high).alias("extent"), F.array(*[b.cast("double") for b in bars]).alias("bar_x"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", row(F.lit(0), 100 + size, size, 2 * size, 3 * size, F.lit(100)).alias("a"), row(size % 7, F.lit(90), k % 50, k % 80, F.lit(90)).alias("b"), (size % 60).alias("dx"))
    out = layout.shared_bars(pairs, "a", "b", "dx")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    return out.select("p_partkey", text("bars_a").alias("bars_a"), text("bars_b").alias("bars_b"))


@query
def page_frames(spark, sf_dir):
    """The frames of a page's run (TOP-7), and pages that have too few or none (CHK-3)."""
    k = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("video_id"), F.lit(0).alias("page"), layout.trimmed_frames((k % 4) / 4, (k % 4) / 4 + F.col("p_size") / 10, F.lit(12.0), F.lit(55)).alias("frames"))
    held = layout.page_shortage(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id")), pages)
    out = held.join(pages, "video_id", "left")
    return out.select("video_id", F.size("frames").alias("n"), F.get("frames", F.lit(0)).alias("first"), F.element_at(F.when(F.size("frames") > 0, F.col("frames")), -1).alias("last"), "refused")


@query
def grid_cells(spark, sf_dir):
    dealt = ordered.near_even_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 10)
    x, y = layout.cell_place("cell", "crop_w", columns=4)
    return dealt.withColumn("crop_w", F.lit(50)).select("o_custkey", "o_orderkey", "grid", x.alias("x"), y.alias("y"))


def _sheet(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = (F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 60_000_000) - 28_000_000).cast("double")
    from notegrid.plans.catalogue import row_cuts

    rows = row_cuts(spark, sf_dir).withColumnRenamed("user_id", "video_id")
    notes = e.where("event_type <> 'signup'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), (1 + F.col("event_id") % 6).cast("int").alias("string"), x.alias("x"), F.when(F.col("event_id") % 9 > 0, (F.col("event_id") % 25).cast("int")).alias("fret"), F.when(F.col("event_id") % 4 == 0, "flagged").otherwise("verified").alias("status"))
    bars = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("video_id")).agg(F.sort_array(F.collect_set(x)).alias("bar_x"))
    tabs = e.select(F.col("user_id").alias("video_id")).distinct().join(bars, "video_id", "left").select("video_id", F.lit(15_000.0).alias("tab_width_px"), F.coalesce("bar_x", F.array().cast("array<double>")).alias("bar_x"))
    return notes, rows, tabs


@query
def sheet_numbers(spark, sf_dir):
    notes, rows, tabs = _sheet(spark, sf_dir)
    out = layout.placements(notes, rows, tabs)
    return out.select("video_id", "id", "r", "page", "text", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "flagged")


@query
def sheet_bars(spark, sf_dir):
    _, rows, tabs = _sheet(spark, sf_dir)
    return layout.row_bars(tabs, rows).select("video_id", "r", F.round("x", 4).alias("x"))


@query
def flagged_rows(spark, sf_dir):
    notes, rows, tabs = _sheet(spark, sf_dir)
    return reading.report_rows(layout.placements(notes, rows, tabs), rows.select("video_id", "r", "split"), ["video_id"])


@query
def sheet_files(spark, sf_dir):
    """The sheets as PDF bytes, by their pages and the operators in them (SNK-4)."""
    notes, rows, tabs = _sheet(spark, sf_dir)
    final = notes.withColumn("n", F.lit(1))
    made = drawing.sheets(layout.placements(notes, rows, tabs), rows, layout.row_bars(tabs, rows), reading.headers(final, ["video_id"]), tabs)
    text = F.decode("pdf", "ISO-8859-1")
    return made.select("video_id", "pages", F.startswith(text, F.lit("%PDF-1.4")).alias("pdf"), F.regexp_count(text, F.lit(" re f")).cast("long").alias("numbers"), F.regexp_count(text, F.lit("0\\.85 0 0 rg")).cast("long").alias("red"), F.regexp_count(text, F.lit("/Type /Page ")).cast("long").alias("objects"))


@query
def plot_places(spark, sf_dir):
    """Where a change stands on a picture's scale of decades (SCA-4)."""
    return table(spark, sf_dir, "events").select("event_id", drawing.decade_place(F.col("value") / 1000, 120).alias("y"))


@query
def html_pictures(spark, sf_dir):
    """Pictures as sources in a page (STR-9): base64 of their bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", drawing.embedded(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("src"))
