"""The queries over the driver's tables: each runs one operator on an analogue
(a group for a video, a category for a string, a time for a position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.config import DEFAULTS
from notegrid.operators import decide, image, match, ordered, vectors
from notegrid.plans import reading
from notegrid.plans.oracles import SQL as SQL
from notegrid.sources import inputs
from notegrid.sources.shared import new_path
from notegrid.streaming.runs import anchored_runs_stream as runs_of_stream

QUERIES: dict = {}
TOL = 21_600_000_000  # six hours in microseconds
WIDTH = 2_160_000_000_000.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fret = F.floor("value") % 25
    truth = e.where("event_id % 2 = 0").select("user_id", "event_type", F.col("event_id").alias("i"), micros("ts").alias("x"), fret.alias("fret"))
    pred = e.where("event_id % 2 = 1").select("user_id", "event_type", F.col("event_id").alias("j"), micros("ts").alias("x"), fret.alias("fret"), (F.col("value") > 150).alias("flagged"))
    return truth, pred


KEYS = ["user_id", "event_type"]


@query
def match_pairs(spark, sf_dir):
    truth, pred = _sides(spark, sf_dir)
    return match.match_pairs(truth.drop("fret"), pred.drop("fret", "flagged"), KEYS, TOL).select(*KEYS, "i", "j", "dx")


@query
def match_metrics(spark, sf_dir):
    truth, pred = _sides(spark, sf_dir)
    out = match.metrics(match_pairs(spark, sf_dir), truth, pred, WIDTH, KEYS)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query
def targets_failed(spark, sf_dir):
    return match.targets_failed(match_metrics(spark, sf_dir)).select("metric", "kind", "bound", "value")


@query
def change_series(spark, sf_dir):
    return ordered.change_series(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", F.round("change", 6).alias("change"))


@query
def true_runs(spark, sf_dir):
    return ordered.true_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") >= 50, 2)


@query
def anchored_runs(spark, sf_dir):
    return ordered.anchored_runs(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value", 60, 90)


@query
def merge_runs(spark, sf_dir):
    day = F.floor(micros("o_orderdate") / 86_400_000_000)
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + 20).alias("b"))
    return ordered.merge_spans(spans, ["o_custkey"], "a", "b", 30, ["a", "o_orderkey"])


@query
def join_marks(spark, sf_dir):
    hour, level = F.floor(micros("ts") / 3_600_000_000), F.floor("value") % 20
    boxes = table(spark, sf_dir, "events").select(*KEYS, "event_id", hour.alias("x0"), level.alias("y0"), (hour + 5 + F.col("event_id") % 7).alias("x1"), (level + 10).alias("y1"))
    return ordered.join_marks(boxes, KEYS, ("x0", "y0", "x1", "y1"), "event_id", 0.5, 3.0)


@query
def dense_ids(spark, sf_dir):
    return ordered.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_type", "event_id"], "note_id").select("event_id", "user_id", "note_id")


@query
def split_grids(spark, sf_dir):
    out = ordered.near_even_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)
    return out.select("o_custkey", "o_orderkey", "grid", (F.col("cell") % 2).alias("gx"), F.expr("cell div 2").alias("gy"))


@query
def even_sample(spark, sf_dir):
    return ordered.even_sample(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "position")


@query
def time_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return ordered.time_grid(p, (10 + F.col("p_size")).cast("double"), F.col("p_partkey") % 300 + 1, 12).select("p_partkey", "k", "t", "frame")


@query
def canvas_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").cast("long").alias("w"))
    return ordered.running_offsets(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "w").select("l_orderkey", "l_linenumber", "offset")


@query
def bar_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("cover", F.col("value") / 400)
    out = ordered.isolated_peaks(rows, ["user_id"], ["ts", "event_id"], "cover", 0.1, 0.05)
    return out.select("user_id", "a", "b", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query
def coverage(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return ordered.coverage(each, ["label", "pos"], F.col("v") > -0.2).withColumn("cover", F.round("cover", 6))


@query
def otsu_levels(spark, sf_dir):
    return vectors.otsu_levels(table(spark, sf_dir, "events").select("event_type", (F.floor("value") % 256).alias("level")), ["event_type"], "level")


def _doubles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query
def ncc_pairs(spark, sf_dir):
    pairs = vectors.next_pairs(_doubles(spark, sf_dir), ["label"], "vec_id", "embedding")
    return pairs.select("vec_id", "next_id", F.round(F.expr(vectors.ncc("embedding", "next_value", "size(embedding)")), 6).alias("ncc"))


@query
def shift_best(spark, sf_dir):
    pairs = vectors.next_pairs(_doubles(spark, sf_dir), ["label"], "vec_id", "embedding").repartition("vec_id")
    best = vectors.best_shift(vectors.shift_scan(pairs, "embedding", "next_value", 6), DEFAULTS.stitch_exclude)
    return best.select("vec_id", "next_id", "shift", "ncc", "second_shift", "second_ncc", vectors.refusal(DEFAULTS.stitch_min_ncc, DEFAULTS.stitch_min_margin).alias("refused"))


@query
def template_median(spark, sf_dir):
    return vectors.element_medians(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "pos", F.round("median", 6).alias("median"))


@query
def template_loo(spark, sf_dir):
    loo = vectors.leave_one_out_medians(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").where("loo IS NOT NULL")
    return vectors.grouped_ncc(loo, ["label", "vec_id"], "v", "loo").select("label", "vec_id", F.round("ncc", 5).alias("class_ncc"))


@query
def template_read(spark, sf_dir):
    scores = vectors.class_scores(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return vectors.read_template(scores, ["vec_id"], 0.3, DEFAULTS.template_min_margin)


@query
def template_digits(spark, sf_dir):
    scores = vectors.template_scores(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.0, DEFAULTS.template_min_samples)
    return vectors.read_template(scores, ["vec_id"], 0.3, DEFAULTS.template_min_margin)


@query
def page_median(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("page", F.expr("vec_id div 31"))
    return vectors.element_medians(e, ["page"], "embedding").select("page", "pos", F.round("median", 6).alias("median"))


@query
def bar_residual(spark, sf_dir):
    p = F.floor("value")
    sides = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "signup", p)).alias("a"), F.collect_set(F.when(F.col("event_type") == "purchase", p)).alias("b"))
    return vectors.nearest_residual(sides, ["user_id"], "a", "b")


@query
def classify_marks(spark, sf_dir):
    high = 1 + F.col("l_partkey") % 16
    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("y0"), (F.col("l_quantity") + high).alias("y1"),
                                                    F.lit(10.0).alias("s"), F.array(*[F.lit(float(y)) for y in range(0, 60, 10)]).alias("line_y"))
    return image.classified(image.in_band(marks)).select("l_orderkey", "l_linenumber", "l_partkey", "dropped", "string")


@query
def composite(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", ((F.col("vec_id") % 7) * 16).alias("o"), F.col("embedding").cast("array<double>").alias("e"))
    return vectors.composite(e, ["label"], "o", "e").select("label", "x", F.round("v", 6).alias("v"))


def _x():
    return (F.floor(micros("ts") / 60_000_000) - 28_000_000).cast("double")


@query
def row_cuts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", _x().alias("x"))
    bar = F.col("event_type") == "signup"
    spans = e.groupBy("user_id").agg(F.max("x").alias("e"), F.array_sort(F.collect_set(F.when(bar, F.col("x")))).alias("bars"), F.array_sort(F.collect_set(F.when(~bar, F.col("x")))).alias("notes"))
    return ordered.cut_rows(spans, ["user_id"], "bars", "notes", "e", 15_000)


@query
def notes_in_rows(spark, sf_dir):
    notes = table(spark, sf_dir, "events").where("event_type <> 'signup'").select("user_id", "event_id", _x().alias("x"))
    out = decide.place_in_rows(notes, row_cuts(spark, sf_dir), ["user_id"])
    return out.select("user_id", "event_id", "r", F.round((F.col("x") - F.col("x0")) * 0.25, 6).alias("px"), F.expr("r div 12").alias("page"))


@query
def digit_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("boxes", 1 + F.col("p_partkey") % 2)
    return decide.digit_labels(rows, ["p_partkey"], "p_size", "boxes")


@query
def fret_texts(spark, sf_dir):
    t = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    rows = table(spark, sf_dir, "part").withColumn("t", F.when(k == 0, F.concat(F.lit("0"), t)).when(k == 1, F.concat(t, F.lit("?"))).otherwise(t))
    return rows.select("p_partkey", decide.fret_of("t", DEFAULTS.max_fret).alias("fret"))


BAD = ('{"notes": [{"id": 1, "fret": null}]}', '{"notes": [{"id": 1, "fret": 25}]}', '{"notes": [{"id": 1, "fret": "3"}]}', '{"notes": [{"id": 1}]}', '{"notes": [{"id": 1, "fret": 2, "x": 1}]}', '{"notes": [{"id": 1, "fret"', '{"notes": [{"id": 1, "fret": true}]}')


@query
def json_validate(spark, sf_dir):
    k = F.col("event_id") % 9
    text = F.when(k == 0, F.format_string('{"notes": [{"id": %d, "fret": 3}]}', "event_id"))
    for i, t in enumerate(BAD):
        text = text.when(k == i + 1, F.lit(t))
    rows = table(spark, sf_dir, "events").select("event_id", text.otherwise(F.col("props")).alias("t"))
    return decide.json_check(rows, "t", DEFAULTS.max_fret).select("event_id", "reason")


#: Answers to a call for ids 1 and 2: what the prompt, the candidate and its text are.
ANSWERS = (
    '{"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "hm", "thought": true}, {"text": "{\\"notes\\": [{\\"id\\": 2, \\"fret\\": 7}, "}, {"text": "{\\"id\\": 1, \\"fret\\": null}]}"}]}}]}',
    '{"prompt_feedback": {"block_reason": "SAFETY"}, "candidates": []}',
    '{"candidates": []}',
    '{"candidates": [{"finish_reason": "MAX_TOKENS", "content": {"parts": [{"text": "{}"}]}}]}',
    '{"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "hm", "thought": true}]}}]}',
    '{"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "sorry"}]}}]}',
    '{"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "{\\"notes\\": [{\\"id\\": 1, \\"fret\\": 31}]}"}]}}]}',
    '{"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "{\\"notes\\": [{\\"id\\": 1, \\"fret\\": 3}, {\\"id\\": 3, \\"fret\\": 3}]}"}]}}]}',
)


@query
def grid_readings(spark, sf_dir):
    k = F.col("o_orderkey") % len(ANSWERS)
    text = F.get(F.array(*[F.lit(a) for a in ANSWERS]), k.cast("int"))
    calls = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("response"), F.array(F.lit(1), F.lit(2)).alias("ids"))
    checked = decide.check_responses(calls, "response", "ids", DEFAULTS.max_fret)
    return decide.scattered(checked, ["o_orderkey", "reason"], "ids").select("o_orderkey", "id", "fret", "valid", "reason")


@query
def note_frets(spark, sf_dir):
    number = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split((F.col("p_partkey") % 120).cast("string"), "")).alias("pos", "c")).where("c <> ''")
    digits = number.withColumn("digit", F.when(F.col("c") != "7", F.col("c")))
    return decide.note_readings(digits, ["p_partkey"], "pos", "digit", DEFAULTS.max_fret)


@query
def id_sets(spark, sf_dir):
    got = F.when(F.col("l_partkey") % 13 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(got).alias("got"), F.sequence(F.lit(1), F.count("*").cast("int")).alias("want"))
    return decide.id_set_check(rows, ["l_orderkey"], "want", "got")


@query
def token_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("role"), "l_linestatus", F.col("l_partkey").alias("input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("input_price"), F.col("p_size").alias("output_price"))
    costs = decide.token_cost(calls, prices, "model")
    return costs.groupBy("role").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("total_usd"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("cost"))), 4).alias("new_usd"))


@query
def status_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    every = [r[0] for r in e.select("event_type").distinct().collect()]  # a handful of statuses
    return reading.categories(e, "event_type", [*every, "none of these"], F.count_if(F.col("value") > 150).alias("flagged"))


@query
def url_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("file", F.regexp_replace("url", "^https?://", ""))
    return pages.select("page_id", inputs.video_id("url").alias("video"), inputs.video_id("file").alias("stem"), inputs.is_url("url").alias("is_url"))


CROPS = ("0,0,1920,484", " 10, 20 ,30,40", "0,0,0,5", "1,2,3", "1000,0,1000,10", "a,b,c,d")


@query
def job_checks(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.lpad(k.cast("string"), 11, "x")
    source = F.when(k % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), name)).when(k % 4 == 1, F.concat(F.lit("https://example.org/"), k.cast("string"))).otherwise(F.concat(F.lit("clips/take."), k.cast("string"), F.lit(".mp4")))
    crop = F.get(F.array(*[F.lit(c) for c in CROPS], F.lit(None)), (k % 7).cast("int"))
    layout = F.when(k % 5 == 1, "scroll").when(k % 5 != 2, "paged-strip")
    jobs = table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), crop.alias("crop"), layout.alias("layout"), F.lit(1920).alias("width"), F.when(k % 11 != 0, 1080).alias("height"))
    return inputs.job_refusals(jobs).select("p_partkey", "video_id", F.col("area.x").alias("x"), F.col("area.w").alias("w"), "refused")


@query
def even_rows(spark, sf_dir):
    places = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("x"))
    return ordered.even_groups(places, ["user_id"], "x", "event_id", 0.8)


@query
def merge_pages(spark, sf_dir):
    videos = table(spark, sf_dir, "embeddings").withColumn("video", F.expr("vec_id div 256"))
    return vectors.merge_similar(videos, ["label", "video"], "vec_id", "embedding", 0.1)


@query
def components(spark, sf_dir):
    ink = F.unhex(F.array_join(F.transform("embedding", lambda v: F.when(v > 0, "00").otherwise("FF")), ""))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("video_id"), F.lit(0).alias("k"), F.lit(8).alias("h"), F.lit(8).alias("w"), ink.alias("px"))
    return image.marks(images).select(F.col("video_id").alias("vec_id"), "x0", "y0", "x1", "y1")


@query
def anchored_runs_stream(spark, sf_dir):
    path, out = f"{sf_dir}/events.parquet", new_path(spark, "runs")
    # as a glob, since a stream takes a plain path for a directory of files
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    runs = runs_of_stream(events, 60, 90)
    sink = runs.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True)
    sink.start(out).awaitTermination()
    return spark.read.schema(runs.schema).parquet(out)


from notegrid.plans import catalogue_flow, catalogue_images  # noqa: E402

QUERIES.update(catalogue_flow.QUERIES)
QUERIES.update(catalogue_images.QUERIES)
