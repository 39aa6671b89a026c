"""Tables and arrays written between steps, in the folder that all executors share."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only where spark.checkpoint.dir is unset and Spark runs in one process (tests) a folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clipweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table in a new shared folder and reads it again, which cuts its lineage."""
    path = folder(spark, "summary")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return keep


def local_path(path: str) -> str | None:
    return path[5:].replace("//", "/") if path.startswith("file:") else path if "://" not in path else None


def put(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays under a path of shared storage; a repeated task writes the same."""
    for name, array in arrays.items():
        to = f"{path}.{name}.npy"
        raw = io.BytesIO()
        np.save(raw, array)
        if local := local_path(to):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            fd, tmp = tempfile.mkstemp(dir=os.path.dirname(local))
            with os.fdopen(fd, "wb") as f:
                f.write(raw.getvalue())
            os.replace(tmp, local)
        else:
            fs, at = pyarrow.fs.FileSystem.from_uri(to)
            with fs.open_output_stream(at) as f:
                f.write(raw.getvalue())


def get(path: str, *names: str) -> dict[str, np.ndarray]:
    """Map arrays into memory; from storage that is no file system they are read."""
    out = {}
    for name in names:
        at = f"{path}.{name}.npy"
        if local := local_path(at):
            out[name] = np.asarray(np.load(local, mmap_mode="r"))
        else:
            fs, key = pyarrow.fs.FileSystem.from_uri(at)
            with fs.open_input_stream(key) as f:
                out[name] = np.load(io.BytesIO(f.read()))
    return out
