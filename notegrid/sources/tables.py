"""Validated JSON tables and the content-addressed call cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = "STRUCT<model: INT, template: INT, reread: INT>"
NOTE = f"STRUCT<id: INT, string: INT, x: DOUBLE, fret: INT, status: STRING, readers: {READERS}>"
ROW = "STRUCT<origin_x: DOUBLE, extent: ARRAY<DOUBLE>, s: DOUBLE, line_y: ARRAY<DOUBLE>, bar_x: ARRAY<DOUBLE>>"
TAB = f"video_id STRING, tab_width_px DOUBLE, row {ROW}, notes ARRAY<{NOTE}>"


_TOP = ("notes", "row", "tab_width_px", "video_id")
_ROW = ("bar_x", "extent", "line_y", "origin_x", "s")
_NOTE = ("fret", "id", "readers", "status", "string", "x")
_READERS = ("model", "reread", "template")


def _members(v) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _closed(v, allowed: tuple[str, ...], required: tuple[str, ...] = ()) -> Column:
    """Whether a variant is an object with the required members and no others than the allowed."""
    keys, arrays = _members(v), [F.array(*[F.lit(x) for x in names]) for names in (allowed, required or ("",))]
    missing = F.size(F.array_except(arrays[1], keys)) == 0 if required else F.lit(True)
    return F.coalesce(keys.isNotNull() & (F.size(F.array_except(keys, arrays[0])) == 0) & missing, F.lit(False))


def _kind(v, path: str) -> Column:
    """VOID for null, null for a missing member, else the member's type."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _whole(v, path: str, low: int, high: int | None = None) -> Column:
    n = F.try_variant_get(v, path, "bigint")
    inside = (n >= low) if high is None else n.between(low, high)
    return F.coalesce((_kind(v, path) == "BIGINT") & inside, F.lit(False))


def _number(v, path: str) -> Column:
    return F.coalesce(_kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def read_tabs(spark: SparkSession, path: str, prediction: bool = False) -> DataFrame:
    """One row per JSON document (a file each), with the first reason it is
    refused (SRC-6, SRC-7, JSN-3); a bad document does not stop the others.
    Types, ranges, required and unknown members are judged on the document
    itself, as a typed reading could not tell a missing member from a null."""
    tabs = spark.read.text(path, wholetext=True).withColumn("_v", F.try_parse_json("value"))
    tabs = tabs.withColumn("_notes", F.try_variant_get("_v", "$.notes", "array<variant>")).withColumn("_t", F.from_json("value", TAB))
    tabs = tabs.select("_t.*", "_v", "_notes")
    bad = lambda test: F.exists("_notes", lambda n: ~test(n))
    missing = lambda n, path: _kind(n, path).isNull()
    null = lambda n: F.coalesce(_kind(n, "$.fret") == "VOID", F.lit(False))
    status = lambda n: F.try_variant_get(n, "$.status", "string")
    reading = lambda n, r: missing(n, f"$.readers.{r}") | F.coalesce(_kind(n, f"$.readers.{r}") == "VOID", F.lit(False)) | _whole(n, f"$.readers.{r}", 0, 24)
    numbers = lambda p: F.coalesce(F.forall(F.try_variant_get("_v", p, "array<variant>"), lambda x: _number(x, "$")), F.lit(False))
    count = lambda p: F.size(F.try_variant_get("_v", p, "array<variant>"))
    top = F.coalesce((_kind(F.col("_v"), "$.video_id") == "STRING") & (F.try_variant_get("_v", "$.video_id", "string") != ""), F.lit(False)) & _number(F.col("_v"), "$.tab_width_px") & F.coalesce(F.try_variant_get("_v", "$.tab_width_px", "double") > 0, F.lit(False)) & F.col("_notes").isNotNull()
    row = _closed(F.try_variant_get("_v", "$.row", "variant"), _ROW, _ROW) & _number(F.col("_v"), "$.row.origin_x") & _number(F.col("_v"), "$.row.s") & F.coalesce(F.try_variant_get("_v", "$.row.s", "double") > 0, F.lit(False)) & numbers("$.row.bar_x") & numbers("$.row.extent") & (count("$.row.extent") == 2) & numbers("$.row.line_y") & (count("$.row.line_y") == 6)
    reason = (F.when(F.col("_v").isNull(), "not JSON")
              .when(~_closed(F.col("_v"), _TOP), "unknown member").when(~top, "required")
              .when(~missing(F.col("_v"), "$.row") & ~row, "row")
              .when(bad(lambda n: _closed(n, _NOTE, ("fret", "string", "x")) & _whole(n, "$.string", 1, 6) & _number(n, "$.x") & (missing(n, "$.id") | _whole(n, "$.id", 0))), "note")
              .when(bad(lambda n: null(n) | _whole(n, "$.fret", 0, 24)), "fret")
              .when(bad(lambda n: missing(n, "$.status") | F.coalesce(status(n).isin("verified", "flagged"), F.lit(False))), "status")
              .when(bad(lambda n: missing(n, "$.readers") | (_closed(F.try_variant_get(n, "$.readers", "variant"), _READERS) & reading(n, "model") & reading(n, "template") & reading(n, "reread"))), "readers")
              .when(bad(lambda n: ~null(n) | F.coalesce(status(n) == "flagged", F.lit(False))), "null fret is not flagged"))
    if prediction:
        reason = reason.when(bad(lambda n: ~missing(n, "$.status")), "status")
    return tabs.withColumn("refused", reason).drop("_v", "_notes")


def tab_notes(tabs: DataFrame) -> DataFrame:
    """The notes of the documents that are not refused."""
    return tabs.where("refused IS NULL").select("video_id", "tab_width_px", F.posexplode("notes").alias("pos", "n")).select("video_id", "tab_width_px", "pos", "n.*")


def call_keys(calls: DataFrame, content: str, *params: str) -> DataFrame:
    """Key of a call: 32 hex digits over its content and parameters, sorted by name (HSH-2, JSN-5)."""
    canonical = F.to_json(F.struct(*[F.col(p) for p in sorted(params)]), {"ignoreNullFields": "false"})
    return calls.withColumn("key", F.substring(F.sha2(F.concat(F.col(content).cast("string"), canonical), 256), 1, 32))


def cached_calls(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """First valid attempt of each wanted key, else the last one; ``new`` where
    the cache has none (SRC-12, CTL-5)."""
    best = cache.groupBy("key").agg(F.coalesce(F.min_by(F.struct("attempt", "valid", "response"), F.when(F.col("valid"), F.col("attempt"))), F.max_by(F.struct("attempt", "valid", "response"), "attempt")).alias("call"))
    return wanted.join(best, "key", "left").select(*wanted.columns, F.col("call").isNull().alias("new"), "call.attempt", "call.valid", "call.response")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls of a folder or glob (SRC-13), a JSON file each, named by its
    key or in a folder that is, as sinks.record_calls writes them."""
    calls = spark.read.text(path, wholetext=True).select("value", "_metadata")
    folder, name = F.regexp_extract(F.col("_metadata.file_path"), r"/call=([^/]*)/[^/]*$", 1), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    calls = calls.withColumn("key", F.when(folder != "", folder).otherwise(name))
    got = F.from_json("value", "role STRING, model STRING, attempt INT, ids ARRAY<INT>")
    whole = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.response", "variant"))
    return calls.withColumn("_c", got).select("key", "_c.*", whole.alias("response"))


def read_prompt(spark: SparkSession, text_path: str, schema_path: str) -> tuple[str, str]:
    """(prompt text, schema text) of one version, two small files (SRC-8)."""
    return tuple(spark.read.text(p, wholetext=True).first()[0] for p in (text_path, schema_path))


def prompt_digest(text: Column, schema: Column) -> Column:
    """Digest of a prompt and its canonical schema, a part of the keys of its calls."""
    return F.sha2(F.concat(text, F.to_json(F.parse_json(schema))), 256)
