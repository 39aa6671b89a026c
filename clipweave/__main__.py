"""Command line: unpack samples, report the environment, cut videos into segments, summarise segments."""

from __future__ import annotations

import argparse
import functools
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.align import transcribed
from clipweave.operators import state
from clipweave.plans import runs, summary
from clipweave.plans.segmenters import WordSegmenter
from clipweave.sources import datasets, media, models
from clipweave.sources.providers import ProviderConfig, ProviderError, configured, env_file
from clipweave.sources.shared import keeper


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="clipweave")
    out.add_argument("--threads", type=int, default=2)
    steps = out.add_subparsers(dest="step", required=True)
    a = steps.add_parser("prepare", help="unpack an archive of samples")
    a.add_argument("archive")
    a.add_argument("target")
    a.add_argument("--folder", required=True)
    a = steps.add_parser("doctor", help="what is installed")
    a.add_argument("--need", action="append", default=[], metavar="FILE")
    a = steps.add_parser("segment", help="videos of a folder to a dataset of segments")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--env", default=".env")
    for kind in ("llm", "stt"):
        for name in ("provider", "model", "base-url", "language", "timeout", "max-attempts", "effort"):
            a.add_argument(f"--{kind}-{name}")
    a = steps.add_parser("summarize", help="a dataset of segments to a list of clips")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--features", required=True, help="folder with Parquet tables ends, flags and words")
    a.add_argument("--threshold", type=float)
    return out


def session(threads: int) -> SparkSession:
    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def configuration(kind: str, services: dict[str, models.Service], args: argparse.Namespace) -> ProviderConfig:
    """Command line before environment before file before the service's own defaults."""
    prefix = kind.upper()
    given = {f"{prefix}_{k[4:].upper()}": v for k, v in vars(args).items() if k.startswith(f"{kind}_")}
    file = env_file(Path(args.env).read_text(encoding="utf-8")) if Path(args.env).is_file() else {}
    first = configured(prefix, "none", given, os.environ, file)
    service = models.service(services, first.provider)
    defaults = {f"{prefix}_MODEL": service.model} | ({f"{prefix}_BASE_URL": service.base_url} if service.base_url else {})
    if key := os.environ.get(service.key_variable or "") or file.get(service.key_variable or ""):
        defaults[f"{prefix}_API_KEY"] = key
    return configured(prefix, service.model, given, os.environ, defaults | file)


def transcripts(spark: SparkSession, paths: DataFrame, config: ProviderConfig, adapter: str) -> DataFrame:
    """(video, path, text, words, segments, error_type): a speech client for each partition, its responses read."""
    make = functools.partial(models.client, models.SPEECH, config)

    def run(frames):
        client = make()
        for f in frames:
            yield f.assign(response=[json.dumps(client(p)) for p in f["path"]])

    said = paths.select("video", "path").mapInPandas(run, "video long, path string, response string")
    return said.select("video", "path", transcribed(F.col("response"), adapter).alias("t")).select("video", "path", "t.*")


def segment(args: argparse.Namespace) -> None:
    with runs.recorded(args.input, args.output) as record:
        llm, stt = configuration("llm", models.LANGUAGE, args), models.checked_speech(configuration("stt", models.SPEECH, args))
        record.settings = {"llm": runs.shown(llm), "stt": runs.shown(stt)}
        for services, config in ((models.LANGUAGE, llm), (models.SPEECH, stt)):
            client = models.client(services, config)  # a missing key or module is known before any work
            getattr(client, "preflight", lambda: None)()
        spark = session(args.threads)
        keep = keeper(spark)
        files = datasets.list_videos(spark, args.input).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
        rows = keep(files.orderBy("path").withColumn("video", F.monotonically_increasing_id()), "videos")
        record.input_video_count = rows.count()
        if not record.input_video_count:
            raise ValueError("the folder has no videos")
        heard = keep(transcripts(spark, rows, stt, "local" if stt.provider == "whisper_local" else "hosted"), "transcripts")
        length = F.coalesce(F.element_at("words", -1)["end"], F.lit(0.0))
        videos = rows.join(heard.select("video", length.alias("seconds")), "video").withColumn("topics", F.array().cast("array<string>"))
        done = WordSegmenter(functools.partial(models.client, models.LANGUAGE, llm), keep, least=5, longest=120, most_attempts=llm.max_attempts).with_global_topics(videos, heard)
        # the array is in the order of the segments
        rows = F.array_sort(F.collect_list(F.struct("order", "content", "start", "end", "video_topic", "global_topic", "video_path")))
        cells = F.transform(rows, lambda s: F.struct(s["content"].alias("content"), s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), s["video_topic"].alias("video_topic"), s["global_topic"].alias("global_topic"), s["video_path"].alias("video_path")))
        name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
        out = done.groupBy("video").agg(cells.alias("segments")).join(videos.select("video", "path", name.alias("name")), "video")
        datasets.dump_videos(out.select("name", "path", F.array_distinct(F.transform("segments", lambda s: s["video_topic"])).alias("topics"), "segments"), args.output, os.getcwd())


def summarize(args: argparse.Namespace) -> None:
    spark = session(args.threads)
    videos = datasets.read_videos(spark, args.input, os.getcwd())
    if videos.isEmpty() or not datasets.invalid_videos(videos).isEmpty():
        raise ValueError("a dataset needs videos, and each of them segments")
    seg = datasets.segments(videos)
    table = lambda name: spark.read.parquet(f"{args.features}/{name}")
    steps = [summary.introduction(table("ends")), summary.subjectivity(table("flags")), summary.content_redundancy(args.threshold), summary.quality(table("words")), summary.chronology()]
    out, _ = summary.summarize(seg, steps, keeper(spark))
    clips = state.edit_list(out.select("pos", "video_path", "start", "end"))
    if clips.isEmpty():
        raise ValueError("nothing was chosen")
    clips.coalesce(1).write.mode("overwrite").option("header", True).csv(args.output)


def doctor(args: argparse.Namespace) -> None:
    report = runs.environment(files=tuple(args.need))
    print(json.dumps(report, indent=2))
    if report["missing_files"]:
        raise FileNotFoundError("files are missing; run prepare")


STEPS = {"prepare": lambda a: print("\n".join(media.unpack(a.archive, a.target, a.folder))), "doctor": doctor, "segment": segment, "summarize": summarize}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        STEPS[args.step](args)
    except (ProviderError, ValueError, OSError) as e:
        print(f"clipweave: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
