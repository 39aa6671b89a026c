"""Media files: audio for upload, durations, pictures every few seconds, archives with samples."""

from __future__ import annotations

import contextlib
import io
import shutil
import stat
import subprocess
import tempfile
import wave
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.operators.selection import frames_within, sample_frames
from clipweave.sources.providers import Configuration, NoSpeech, TimedOut

#: Audio that services take as it is.
AUDIO = (".aac", ".aiff", ".flac", ".m4a", ".mp3", ".oga", ".ogg", ".opus", ".wav", ".weba")
#: What an archive of samples may not bring.
PROGRAMS = (".exe", ".dll", ".bat", ".cmd", ".ps1", ".py")


def audio_command(ffmpeg: str, source: str, target: str) -> list[str]:
    """Mono, 16 kHz, 16 bits. Time stamps are kept, so a delayed sound track stays delayed."""
    reading = ["-nostdin", "-hide_banner", "-loglevel", "error", "-y", "-copyts", "-start_at_zero", "-i", source]
    sound = ["-map", "0:a:0", "-vn", "-ac", "1", "-ar", "16000", "-af", "aresample=async=1:first_pts=0", "-c:a", "pcm_s16le"]
    return [ffmpeg, *reading, *sound, target]


@contextlib.contextmanager
def upload_audio(path: str, timeout: float, run=subprocess.run, which=shutil.which) -> Iterator[str]:
    """A path of audio: the file itself, or what ffmpeg takes out of it, gone afterwards."""
    if not Path(path).is_file():
        raise Configuration("no such media file")
    if Path(path).suffix.lower() in AUDIO:
        yield path
        return
    ffmpeg = which("ffmpeg")
    if not ffmpeg:
        raise Configuration("ffmpeg is needed to take audio out of a video")
    with tempfile.TemporaryDirectory() as folder:  # one task's own file, sent within the task
        target = str(Path(folder) / "audio.wav")
        try:
            run(audio_command(ffmpeg, path, target), check=True, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, timeout=timeout)
        except subprocess.TimeoutExpired:
            raise TimedOut("audio took too long") from None
        except subprocess.CalledProcessError as e:
            raise NoSpeech("no sound track") if b"matches no streams" in (e.stderr or b"") else Configuration("audio can't be read") from None
        yield target


def wav_duration(content: Column) -> Column:
    """Seconds of a WAV file's bytes; null if it is none."""

    @F.pandas_udf("double")
    def run(files: pd.Series) -> pd.Series:
        def one(raw) -> float | None:
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    return w.getnframes() / w.getframerate()
            except (wave.Error, EOFError, ZeroDivisionError, TypeError):
                return None

        return files.map(one).astype("float64")

    return run(content)


def pictures(videos: DataFrame, segments: DataFrame, every: float = 5.0) -> DataFrame:
    """(video_index, segment_index, frame_no, t): the frames taken every so many seconds of a video (video_index, fps, n_frames), counted from its first, that a segment holds."""
    return frames_within(sample_frames(videos, 1 / every), segments).select("video_index", "segment_index", "frame_no", "t")


def unpack(archive: str, target: str, folder: str) -> list[str]:
    """Unpack plain files below one folder; any other entry rejects the whole archive. A file that is there in its size is left. Returns what was written."""
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for e in z.infolist():
            parts = PurePosixPath(e.filename.replace("\\", "/")).parts
            odd = not parts or parts[0] != folder or ".." in parts or stat.S_ISLNK(e.external_attr >> 16) or PurePosixPath(*parts).suffix.lower() in PROGRAMS
            if odd:
                raise ValueError(f"unexpected entry {e.filename}")
        written = []
        for e in z.infolist():
            to = root / e.filename.replace("\\", "/")
            if e.is_dir() or (to.exists() and to.stat().st_size == e.file_size):
                continue
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_name(f"{to.name}.part")
            part.write_bytes(z.read(e))
            part.rename(to)
            written.append(str(to))
    return written


def same_content(files: DataFrame, digest: str) -> DataFrame:
    """Of binary files, those with this SHA-256."""
    return files.where(F.sha2("content", 256) == digest.lower())
