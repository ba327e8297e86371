"""Stages as functions over many videos: each runs for the videos whose key
changed, marks them done last, and a video that is refused stops alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.plans.manifest import stage_keys, stale
from notegrid.sources.sinks import exists

MANIFEST = "video_id STRING, stage STRING, key STRING"


@dataclass(frozen=True)
class Stage:
    """A stage (CTL-7): its version, its parameters as canonical JSON, the inputs
    of its key (video_id, name, content) from a workspace, and a run that writes
    the outputs of the given videos and returns (video_id, refused)."""

    name: str
    version: int
    params: str
    inputs: Callable[[SparkSession, str, DataFrame], DataFrame]
    run: Callable[[SparkSession, str, DataFrame], DataFrame]


def stage_path(root: str, stage: str) -> str:
    """Where a stage's outputs lie, partitioned by video (CTL-3)."""
    return f"{root.rstrip('/')}/{stage}"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest key of each video and stage that ran to its end."""
    path = stage_path(root, "_manifest")
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(f"{MANIFEST}, turn LONG").parquet(path)
    return rows.groupBy("video_id", "stage").agg(F.max_by("key", "turn").alias("key"))


def mark_done(keys: DataFrame, root: str, turn: int) -> None:
    """Append the keys of videos whose outputs are written: the last step of a
    stage, so that one that breaks off runs again (SNK-6)."""
    keys.select("video_id", "stage", "key", F.lit(turn).cast("long").alias("turn")).write.mode("append").parquet(stage_path(root, "_manifest"))


def run_stage(spark: SparkSession, stage: Stage, root: str, videos: DataFrame, force: bool = False) -> DataFrame:
    """Run ``stage`` for the videos whose key the manifest lacks, all with
    ``force`` (CTL-2): (video_id, stage, state, refused), state 'up to date',
    'ran' or 'refused'. Refused videos are not marked."""
    given = stage.inputs(spark, root, videos).withColumn("stage", F.lit(stage.name))
    params = spark.createDataFrame([(stage.name, stage.version, stage.params)], "stage string, version int, params string")
    path = stage_path(root, f"_keys/{stage.name}")
    stage_keys(given, params).write.mode("overwrite").parquet(path)
    keys = spark.read.schema(MANIFEST).parquet(path).join(videos.select("video_id"), "video_id", "left_semi")
    todo = keys if force else stale(keys, manifest(spark, root))
    turn = 1 + spark.read.parquet(stage_path(root, "_manifest")).agg(F.max("turn")).first()[0] if exists(spark, stage_path(root, "_manifest")) else 0
    if todo.limit(1).count():
        told = stage_path(root, f"_runs/{stage.name}-{turn}")
        stage.run(spark, root, todo.select("video_id")).select("video_id", "refused").write.mode("overwrite").parquet(told)
        ended = spark.read.schema("video_id STRING, refused STRING").parquet(told)
        done = todo.join(ended.where("refused IS NULL"), "video_id", "left_semi")
        ran = todo.select("video_id").join(ended, "video_id", "left")
        result = keys.select("video_id").join(ran.withColumn("_ran", F.lit(True)), "video_id", "left")
        mark_done(done, root, turn)
    else:
        result = keys.select("video_id", F.lit(None).cast("string").alias("refused"), F.lit(False).alias("_ran"))
    state = F.when(F.col("refused").isNotNull(), "refused").when(F.col("_ran"), "ran").otherwise("up to date")
    return result.select("video_id", F.lit(stage.name).alias("stage"), state.alias("state"), "refused")


def run_all(spark: SparkSession, stages: list[Stage], root: str, videos: DataFrame, only: str | None = None) -> list[DataFrame]:
    """Run the stages in order (CTL-1), or ``only`` one of them by force; a video
    that a stage refuses is left out of the later ones."""
    names = [s.name for s in stages]
    if only is not None and only not in names:
        raise ValueError(f"no stage {only!r}; there are {', '.join(names)}")
    out = []
    for stage in stages:
        if only is None or stage.name == only:
            result = run_stage(spark, stage, root, videos, force=only is not None)
            path = stage_path(root, f"_told/{stage.name}-{uuid.uuid4().hex}")
            result.write.parquet(path)
            result = spark.read.schema(result.schema).parquet(path)
            out.append(result)
            videos = videos.join(result.where("state = 'refused'"), "video_id", "left_anti")
    return out
