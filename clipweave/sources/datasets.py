"""Segmented datasets as JSON, edit lists, decision logs and tables of calls: reading and writing."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.text import decimal_comma, relative, resolved

SEGMENT = "struct<content:string,start:double,end:double,order:bigint,video_topic:string,global_topic:string,video_path:string>"
VIDEO = f"name string, path string, topics array<string>, segments array<{SEGMENT}>"
#: What a video file may end with, in this case only.
SUFFIXES = (".mp4", ".mov", ".avi", ".mkv")
#: The names under which a saved decision log holds its sets.
LOG_KEYS = {k: f"_SummarySegmentHandler__{k}" for k in ("source", "output", "discard", "include", "pick", "agent_log")}


def read_videos(spark: SparkSession, path: str, root: str | None = None, below: bool = False) -> DataFrame:
    """Videos of JSON arrays; a segment without a path has its video's. With a root, relative paths are resolved. below: of all JSON files in a folder and its folders."""
    reader = spark.read.schema(VIDEO).option("multiLine", True)
    df = (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json") if below else reader).json(path)
    if root:
        df = df.withColumn("path", resolved(F.col("path"), root))
    own = lambda s: F.coalesce(F.nullif(s["video_path"], F.lit("")), F.col("path"))
    full = lambda s: resolved(own(s), root) if root else own(s)
    empty = lambda s, k: F.coalesce(s[k], F.lit(""))
    return df.withColumn("segments", F.transform("segments", lambda s: s.withField("video_path", full(s)).withField("video_topic", empty(s, "video_topic")).withField("global_topic", empty(s, "global_topic"))))


def invalid_videos(videos: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Videos without segments and, with a table of the files that exist (path), those whose file does not."""
    bad = F.coalesce(F.size("segments"), F.lit(0)) <= 0
    if files is None:
        return videos.where(bad)
    there = files.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    return videos.join(there, videos["path"] == there["file"], "left").where(bad | F.col("there").isNull()).select(*videos.columns)


def segments(videos: DataFrame) -> DataFrame:
    """A row a segment. Videos are numbered by name and path, as rows have no order of their own."""
    from pyspark.sql import Window as W

    # One task sees a narrow row a video.
    order = videos.select("name", "path").distinct().withColumn("video_index", F.row_number().over(W.orderBy("name", "path")) - 1)
    rows = videos.join(order, ["name", "path"])
    return rows.select(F.col("video_index").cast("long").alias("video_index"), F.posexplode("segments").alias("segment_index", "s")).select("video_index", F.col("segment_index").cast("long").alias("segment_index"), "s.*")


def write_videos(videos: DataFrame, path: str, root: str | None = None) -> None:
    """Portable paths, as many files as partitions."""
    if root:
        videos = videos.withColumn("path", relative(F.col("path"), root)).withColumn("segments", F.transform("segments", lambda s: s.withField("video_path", relative(s["video_path"], root))))
    videos.write.mode("overwrite").json(path)


def dump_videos(videos: DataFrame, path: str, root: str | None = None) -> None:
    """One indented array in one file, for datasets that a person reads."""
    if root:
        videos = videos.withColumn("path", relative(F.col("path"), root)).withColumn("segments", F.transform("segments", lambda s: s.withField("video_path", relative(s["video_path"], root))))
    rows = [r.asDict(recursive=True) for r in videos.orderBy("name").collect()]
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=4), encoding="utf-8")


def list_videos(spark: SparkSession, folder: str, suffix: str = ".mp4") -> DataFrame:
    """(path, length) of the files below a folder, by path; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return df.select("path", "length").orderBy("path")


def video_file(path: str) -> dict:
    """Name and absolute path of a video file."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(path)
    if p.suffix not in SUFFIXES:
        raise ValueError(f"{p.suffix} is no video format")
    return {"name": p.stem, "path": p.resolve().as_posix()}


def save_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def export_log(state: dict, path: str, root: str | None = None) -> None:
    """The sets of a decision log under the names that other tools expect, paths below the root without it."""
    state = rewritten(state, lambda p: portable(p, root)) if root else state
    Path(path).write_text(json.dumps({LOG_KEYS[k]: v for k, v in state.items()}, ensure_ascii=False, indent=4), encoding="utf-8")


def load_log(path: str, root: str | None = None) -> dict:
    """What export_log wrote; keys that it lacks are empty, others an error."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    names = {v: k for k, v in LOG_KEYS.items()}
    if unknown := raw.keys() - names.keys():
        raise ValueError(f"no decision log: {', '.join(sorted(unknown))}")
    state = {k: {} if k == "agent_log" else [] for k in LOG_KEYS} | {names[k]: v for k, v in raw.items()}
    return rewritten(state, lambda p: p if Path(p).is_absolute() else (Path(root) / p).as_posix()) if root else state


def log_actions(spark: SparkSession, state: dict) -> DataFrame:
    """The agents' logs of a loaded decision log as actions: agent, action, pick_id and the segment's fields."""
    rows = []
    for agent, log in sorted(state["agent_log"].items()):
        for action in ("include", "discard", "output"):
            rows += [(agent, action, None, s) for s in log.get(action) or []]
        rows += [(agent, "pick", k, s) for k, pick in enumerate(log.get("pick") or []) for s in pick]
    return spark.createDataFrame(rows, f"agent string, action string, pick_id long, segment {SEGMENT}").select("agent", "action", "pick_id", "segment.*")


def portable(path: str, root: str) -> str:
    """A path below the root relative to it, any other absolute; `..` and links are resolved."""
    full = (Path(root) / path).resolve()
    base = Path(root).resolve()
    return (full.relative_to(base) if full.is_relative_to(base) else full).as_posix()


def rewritten(data, change: Callable[[str], str]):
    """Nested data with every non-empty path and video_path changed; sets and tuples become lists."""
    if is_dataclass(data) and not isinstance(data, type):
        data = asdict(data)
    if isinstance(data, dict):
        return {k: change(v) if k in ("path", "video_path") and isinstance(v, str) and v else rewritten(v, change) for k, v in data.items()}
    return [rewritten(x, change) for x in data] if isinstance(data, (list, tuple, set, frozenset)) else data


def set_sources(handler: dict, videos: list) -> dict:
    """A decision state with its source videos, which are set once."""
    if handler.get("source"):
        raise ValueError("the sources are set already")
    return handler | {"source": list(videos)}


def read_all_videos(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """The videos of every JSON file below a folder."""
    return read_videos(spark, folder, root, below=True)


def read_labelled(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ";") -> DataFrame:
    """Labelled rows of CSV files, with names from the schema where the file has none."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def write_decimal_commas(rows: DataFrame, path: str, *numbers: str) -> None:
    """CSV for spreadsheets: Latin-1, semicolons, numbers with a decimal comma."""
    for c in numbers:
        rows = rows.withColumn(c, decimal_comma(F.col(c)))
    rows.write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)


def shuffled(rows: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """The rows in an order that the seed and the keys decide, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def append_unseen(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the CSV table lacks, so that a run can go on where it stopped."""
    spark = rows.sparkSession
    try:
        done = spark.read.option("header", True).schema(rows.schema).csv(path).select(key)
        rows = rows.join(done, key, "left_anti").select(*rows.columns)
    except Exception as e:  # Spark tells a missing table only so
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").option("header", True).csv(path)
