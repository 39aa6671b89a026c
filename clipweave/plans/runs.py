"""The record of a run, written whether it ends well or not."""

from __future__ import annotations

import contextlib
import importlib.metadata
import importlib.util
import json
import logging
import platform
import shutil
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from clipweave.sources.providers import ProviderConfig

CALLS = "provider string, model string, step string, request_id long, attempts int, status string, error_type string, seconds double"


@dataclass
class Record:
    """What is known of a run so far; texts of prompts, answers and transcripts never are."""

    input: str
    output: str
    settings: dict | None = None
    input_video_count: int | None = None
    llm_calls: tuple = ()
    stt_calls: tuple = ()


def shown(config: ProviderConfig) -> dict:
    """A configuration without its key."""
    return {k: v for k, v in asdict(config).items() if k != "api_key"}


@contextlib.contextmanager
def recorded(source: str, output: str) -> Iterator[Record]:
    """A record to fill in; `<output's stem>_run.json` gets it at the end, with the error's type if there was one."""
    record, began = Record(source, output), time.monotonic()
    out = {"schema_version": 1, "started_at": datetime.now(timezone.utc).isoformat(), "status": "failed"}
    try:
        yield record
        out["status"] = "completed"
    except BaseException as e:
        out["error_type"] = type(e).__name__
        raise
    finally:
        out |= {k: v for k, v in asdict(record).items() if v is not None} | {"duration_seconds": time.monotonic() - began}
        path = Path(output).with_name(f"{Path(output).stem}_run.json")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


def installed(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy", "regex"), optional: tuple[str, ...] = ("cv2", "torch", "whisper_timestamped"), files: tuple[str, ...] = ()) -> dict:
    """Versions, what is there of optional modules and programs, and files that are missing."""
    return {
        "python": platform.python_version(),
        "packages": {p: installed(p) for p in packages},
        "modules": {m: importlib.util.find_spec(m) is not None for m in optional},
        "ffmpeg_on_path": shutil.which("ffmpeg") is not None,
        "java_on_path": shutil.which("java") is not None,
        "missing_files": [f for f in files if not Path(f).is_file()],
    }


def logger(path: str = "app.log", name: str = "clipweave") -> logging.Logger:
    """Messages to the console and a file; asked for twice it is the same."""
    out = logging.getLogger(name)
    if not out.handlers:
        out.setLevel(logging.INFO)
        for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            out.addHandler(handler)
    return out
