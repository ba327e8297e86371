"""Raw videos (YUV4MPEG2 files): headers, wanted frames, samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.sources.inputs import is_url, video_id

#: Bytes of chroma for each luma byte of a format (fixed values); a file without one is 420.
_CHROMA = {"mono": 0.0, "420": 0.5, "422": 1.0, "444": 2.0}
_MARK = b"FRAME"
SAMPLES = "video_id STRING, k INT, t DOUBLE, frame BIGINT, h INT, w INT, px BINARY"


def header_of(content: bytes) -> tuple[int, int, float, str, int] | None:
    """(width, height, frames a second, chroma, bytes of the header), None if there is none."""
    line, found, _ = content[:4096].partition(b"\n")
    parts = line.decode("latin-1").split(" ")
    if not found or parts[0] != "YUV4MPEG2":
        return None
    given = {p[0]: p[1:] for p in parts[1:] if p}
    rate = re.fullmatch(r"([0-9]+):([0-9]+)", given.get("F", ""))
    chroma = next((c for c in _CHROMA if given.get("C", "420").startswith(c)), None)
    if not (given.get("W", "").isdigit() and given.get("H", "").isdigit() and rate and int(rate[2]) and chroma):
        return None
    return int(given["W"]), int(given["H"]), int(rate[1]) / int(rate[2]), chroma, len(line) + 1


def luma_planes(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(frame number, luma plane) in order; ends early where a frame is cut off."""
    width, height, _, chroma, at = header_of(content)
    size, rest = width * height, int(width * height * _CHROMA[chroma])
    k = 0
    while content[at:at + 5] == _MARK:
        start = content.index(b"\n", at) + 1
        if start + size + rest > len(content):
            return
        yield k, content[start:start + size]
        at, k = start + size + rest, k + 1


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, content) of the files of a folder or glob."""
    return spark.read.format("binaryFile").load(path).select(video_id("path").alias("video_id"), "path", "content")


def probe(files: DataFrame) -> DataFrame:
    """video_id, width, height, fps, frames, and refused: 'unreadable' without a
    header, 'no frames' without a rate or a whole frame (SRC-2)."""
    def run(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["video_id"], pdf["content"]):
                head = header_of(content)
                n = sum(1 for _ in luma_planes(content)) if head else 0
                out.append((name, *(head[:3] if head else (None, None, None)), n, "unreadable" if not head else "no frames" if not n or head[2] <= 0 else None))
            yield pd.DataFrame(out, columns=["video_id", "width", "height", "fps", "frames", "refused"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("video_id", "content").mapInPandas(run, "video_id string, width int, height int, fps double, frames bigint, refused string")


def wanted_frames(samples: DataFrame) -> DataFrame:
    """The distinct (video_id, frame) of samples or of pages' frames (SET-5)."""
    return samples.select("video_id", F.col("frame").cast("bigint").alias("frame")).distinct()


def read_frames(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """video_id, frame, h, w, px of the wanted frames, each video scanned once
    in order (SRC-1), and refused: a row without a picture for the first wanted
    frame that a video ends before."""
    lists = wanted.groupBy("video_id").agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    both = files.select("video_id", "content").join(lists, "video_id")

    def run(batches):
        for pdf in batches:
            for name, content, frames in zip(pdf["video_id"], pdf["content"], pdf["frames"]):
                head = header_of(content)
                left, at = [int(f) for f in frames], 0
                for k, plane in luma_planes(content) if head else ():
                    if at < len(left) and k == left[at]:
                        yield pd.DataFrame([(name, k, head[1], head[0], plane, None)], columns=names)
                        at += 1
                    if at == len(left):
                        break
                if at < len(left):
                    yield pd.DataFrame([(name, left[at], None, None, None, "ended early" if head else "unreadable")], columns=names).astype({"h": "Int32", "w": "Int32"})

    names = ["video_id", "frame", "h", "w", "px", "refused"]
    return both.mapInPandas(run, "video_id string, frame bigint, h int, w int, px binary, refused string")


def spread(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Every sample with its frame's picture: one frame feeds several samples
    where a video has fewer frames than samples a second (JOI-9)."""
    return samples.join(frames.where("refused IS NULL").drop("refused"), ["video_id", "frame"])


def cropped(frames: DataFrame, area: str = "area") -> DataFrame:
    """Pictures cut to their ``area`` (a struct x, y, w, h), row by row (PRJ-1)."""
    rows = F.transform(F.sequence(F.col(f"{area}.y"), F.col(f"{area}.y") + F.col(f"{area}.h") - 1), lambda y: F.substring(F.col("px"), (y * F.col("w") + F.col(f"{area}.x") + 1).cast("int"), F.col(f"{area}.w")))
    cut = F.expr(f"aggregate(slice(_rows, 2, greatest(size(_rows) - 1, 0)), _rows[0], (a, b) -> concat(a, b))")
    return frames.withColumn("_rows", rows).withColumns({"px": cut, "h": F.col(f"{area}.h"), "w": F.col(f"{area}.w")}).drop("_rows")


def write_samples(samples: DataFrame, path: str) -> None:
    """The samples table, replacing what is there (SNK-2)."""
    names = [f.split()[0] for f in SAMPLES.split(", ")]
    samples.select(*names).write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples table as written, with its schema given (SRC-5)."""
    return spark.read.schema(SAMPLES).parquet(path)


def located(jobs: DataFrame, local: DataFrame, source: str = "source") -> DataFrame:
    """``jobs`` plus path, the local file (``local`` has video_id, path) of a
    source, and ``fetch`` where a URL has none yet; refused is 'no file' for a
    missing local source (SRC-3, SRC-14). A job stays one row: of several files
    of one video the first by path is taken."""
    held = local.groupBy(F.col("video_id").alias("_id")).agg(F.min("path").alias("path"))
    out = jobs.join(held, video_id(source) == F.col("_id"), "left").drop("_id")
    out = out.withColumn("fetch", is_url(source) & F.col("path").isNull())
    return out.withColumn("refused", F.when(~is_url(source) & F.col("path").isNull(), "no file"))


def fetched(jobs: DataFrame, download: Callable[[str], bytes], source: str = "source") -> DataFrame:
    """(video_id, path, content, refused) of the jobs to fetch, a row for each
    source, however many jobs ask for it. ``download`` runs on the executors; what
    it raises is the reason a video is refused (SRC-3)."""
    def run(batches):
        for pdf in batches:
            out = []
            for name, url in zip(pdf["video_id"], pdf["path"]):
                try:
                    out.append((name, url, download(url), None))
                except Exception as e:  # whatever a downloader raises refuses its video only
                    out.append((name, url, None, f"download: {e}"))
            yield pd.DataFrame(out, columns=["video_id", "path", "content", "refused"])

    wanted = jobs.where("fetch").select(video_id(source).alias("video_id"), F.col(source).alias("path")).distinct()
    return wanted.mapInPandas(run, "video_id string, path string, content binary, refused string")
