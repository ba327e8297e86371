"""Memoized stages: a stage runs only if its key changed (CTL-2, HSH-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_keys(inputs: DataFrame, params: DataFrame) -> DataFrame:
    """(video_id, stage, key) from inputs (video_id, stage, name, content) and
    params (stage, version, params): base names and bytes in order of name."""
    files = inputs.groupBy("video_id", "stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.sha2(F.col("content").cast("binary"), 256).alias("hash")))), lambda f: F.concat(f["name"], F.lit("="), f["hash"])), "\n").alias("files"))
    return files.join(params, "stage").select("video_id", "stage", F.sha2(F.concat_ws("\n", "files", F.col("version").cast("string"), "params"), 256).alias("key"))


def stale(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stages whose key the manifest does not hold."""
    return keys.join(manifest.select("video_id", "stage", "key"), ["video_id", "stage", "key"], "left_anti")
