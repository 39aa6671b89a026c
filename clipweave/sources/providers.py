"""Configuration of model providers, their errors, and calls with attempts; models themselves are plugged in."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from clipweave.functions.interpret import BadRequest, Invalid, Spec, interpret


class ProviderError(Exception):
    retryable = False


class Configuration(ProviderError):
    pass


class Authentication(ProviderError):
    pass


class NoSpeech(ProviderError):
    pass


class RateLimited(ProviderError):
    retryable = True


class Unavailable(ProviderError):
    retryable = True


class TimedOut(ProviderError):
    retryable = True


#: Codes by which services say that more attempts are of no use.
USED_UP = ("insufficient_quota", "billing_hard_limit_reached")
#: First match decides: what it is by status, by a word in the exception's name, and the error.
RULES: tuple[tuple[tuple[int, ...], str, type[ProviderError], str], ...] = (
    ((401, 403), "Authentication|PermissionDenied", Authentication, "not authorised"),
    ((429,), "RateLimit", RateLimited, "too many requests"),
    ((408, 504), "Timeout", TimedOut, "timed out"),
    ((500, 501, 502, 503), "Connection", Unavailable, "not available"),
    ((400, 404, 409, 422), "BadRequest|NotFound", Configuration, "request not accepted"),
)


def error_of(status: int | None, code: str | None = None, name: str = "") -> ProviderError:
    """By HTTP status or the exception's name; no text of the answer is kept. Used-up quota is final."""
    for statuses, names, kind, says in RULES:
        if status in statuses or re.search(names, name):
            return Configuration("quota used up") if kind is RateLimited and code in USED_UP else kind(says)
    return Configuration("request not accepted") if status is not None and 400 <= status < 500 else Unavailable("not available")


def error_from(error: Exception) -> ProviderError:
    """The same of what a client raised."""
    if isinstance(error, ProviderError):
        return error
    if isinstance(error, (TimeoutError, ConnectionError)):
        return TimedOut("timed out") if isinstance(error, TimeoutError) else Unavailable("not available")
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None) or getattr(error, "code", None)
    body = getattr(error, "body", None)
    detail = body.get("error", body) if isinstance(body, Mapping) else None
    return error_of(status if isinstance(status, int) else None, detail.get("code") if isinstance(detail, Mapping) else None, type(error).__name__)


@dataclass(frozen=True)
class ProviderConfig:
    provider: str
    model: str
    base_url: str | None = None
    api_key: str | None = field(default=None, repr=False)
    language: str | None = None
    timeout: float = 120.0
    max_attempts: int = 3
    effort: str | None = None


def settle(name: str, *layers: Mapping[str, str | None], default: str | None = None) -> str | None:
    """The first layer that has a value which is not blank."""
    for layer in layers:
        if (v := layer.get(name)) is not None and v.strip():
            return v.strip()
    return default


def configured(prefix: str, default_model: str, cli: Mapping[str, str | None], env: Mapping[str, str], file: Mapping[str, str]) -> ProviderConfig:
    """Command line before environment before file before defaults."""
    get = lambda k, d=None: settle(f"{prefix}_{k}", cli, env, file, default=d)
    url = get("BASE_URL")
    if url:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password:
            raise Configuration("base URL must be http(s) without credentials")
    numbers = {}
    for key, d in (("TIMEOUT", 120.0), ("MAX_ATTEMPTS", 3)):
        try:
            x = float(get(key, str(d)))
        except ValueError:
            x = math.nan
        if not math.isfinite(x) or x <= 0:
            raise Configuration(f"{key.lower()} must be a positive number")
        numbers[key] = x
    lang = get("LANGUAGE")
    return ProviderConfig(get("PROVIDER", "offline"), get("MODEL", default_model), url, get("API_KEY"), None if lang in (None, "auto") else lang, numbers["TIMEOUT"], int(numbers["MAX_ATTEMPTS"]), get("EFFORT"))


def env_file(text: str) -> dict[str, str]:
    """The settings of an environment file: NAME=value lines, comments, quotes, an export in front."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip().isidentifier():
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[name.strip()] = value[1:-1] if quoted else value.partition(" #")[0].strip()
    return out


def attempt(call: Callable[[str], str], prompt: str, kind: str | Spec, most: int = 3, base: float = 1.0, cap: float = 10.0, sleep: Callable[[float], None] = time.sleep, **spec):
    """(value, records): one budget of attempts for transport and for answers of another kind."""
    records = []
    for n in range(1, most + 1):
        began = time.monotonic()
        try:
            value, error = interpret(call(prompt), kind, **spec), None
        except (BadRequest, NoSpeech):
            raise
        except Exception as e:
            value, error = None, e if isinstance(e, Invalid) else error_from(e)
        records.append({"attempt": n, "status": "failed" if error else "completed", "error_type": type(error).__name__ if error else None, "seconds": time.monotonic() - began})
        if error is None:
            return value, records
        if not (isinstance(error, Invalid) or error.retryable):
            break
        if n < most:
            sleep(min(base * 2 ** (n - 1), cap))
    return None, records


def generate_pattern(call: Callable[[str], str], prompt: str, pattern: str, most: int = 3, **options) -> str | None:
    """The first match of a pattern in the answer; None after the last attempt."""
    return attempt(call, prompt, Spec("pattern", pattern=pattern), most, **options)[0]


ROWS = 256  # requests that are held at once
ANSWERS = "request_id long, value string, attempts int, error_type string, seconds double"


def generate(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], kind: str, most: int = 3, **spec) -> DataFrame:
    """requests (request_id, prompt) to (request_id, value as JSON, attempts, error_type, seconds), a client for each partition, closed at its end.

    Requests may also have topic_ids, answer_ids (arrays of strings) or max_items of their
    own. Write the result before using it twice: calls are made anew when it is computed anew.
    """
    own = [c for c in ("topic_ids", "answer_ids", "max_items") if c in requests.columns]
    Spec(kind, **{k: tuple(v) if k.endswith("_ids") else v for k, v in spec.items()})  # a bad request fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        try:
            for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
                out = []
                for r in b.to_pylist():
                    value, records = attempt(client, r["prompt"], kind, most, **spec | {k: r[k] if k == "max_items" else r[k] or () for k in own})
                    out.append((r["request_id"], None if value is None else json.dumps(value, ensure_ascii=False), len(records), records[-1]["error_type"], sum(x["seconds"] for x in records)))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["request_id", "value", "attempts", "error_type", "seconds"])
        finally:
            close = getattr(client, "close", None)
            if close:
                close()

    return requests.select("request_id", "prompt", *own).mapInArrow(run, ANSWERS)
