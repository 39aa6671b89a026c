"""Model services by name, and clients that speak to them.

A client is a callable: a language model's from a prompt to an answer, a speech model's
from a media path to a response that clipweave.functions.align reads. Clients are made
in the task that uses them, and nothing is loaded or opened before their first call.
How bytes travel is a parameter (send), so that tests need no service.
"""

from __future__ import annotations

import base64
import importlib
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from clipweave.functions.align import BLANKS
from clipweave.functions.prompts import answer_schema
from clipweave.sources.media import upload_audio
from clipweave.sources.providers import Authentication, Configuration, ProviderConfig, error_from, error_of

Send = Callable[[str, bytes, Mapping[str, str], float], bytes]
#: Efforts that models with reasoning take.
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")


def send(url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> bytes:
    """One POST; errors become this package's own, without what the service said."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers)), timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        try:
            detail = json.loads(e.read()).get("error") or {}
            code = detail.get("code") if isinstance(detail, dict) else None
        except (ValueError, AttributeError):
            code = None
        raise error_of(e.code, code) from None
    except urllib.error.URLError as e:
        raise error_from(e.reason if isinstance(e.reason, Exception) else ConnectionError()) from None


@dataclass
class Ollama:
    """A local service's generate call."""

    config: ProviderConfig
    structured: bool = False
    temperature: float = 0.2
    images: tuple[bytes, ...] = ()
    send: Send = send

    def body(self, prompt: str) -> dict:
        out = {"model": self.config.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}
        if self.structured:
            out["format"] = "json"
        if self.images:
            out["images"] = [base64.b64encode(x).decode() for x in self.images]
        return out

    def __call__(self, prompt: str) -> str:
        url = f"{(self.config.base_url or '').rstrip('/')}/api/generate"
        return json.loads(self.send(url, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json"}, self.config.timeout)).get("response")


@dataclass
class OpenAI:
    """A hosted service's responses call; the answer's schema is part of the request."""

    config: ProviderConfig
    kind: str = "text"
    topic_ids: tuple[str, ...] = ()
    answer_ids: tuple[str, ...] = ()
    temperature: float | None = None
    images: tuple[bytes, ...] = ()
    send: Send = send

    def __post_init__(self):
        if not self.config.api_key:
            raise Authentication("no key")
        if self.config.effort is not None and self.config.effort not in EFFORTS:
            raise Configuration(f"effort is one of {', '.join(EFFORTS)}")

    def body(self, prompt: str) -> dict:
        content = [{"type": "input_text", "text": prompt}]
        content += [{"type": "input_image", "image_url": f"data:image/jpeg;base64,{base64.b64encode(x).decode()}"} for x in self.images]
        out: dict = {"model": self.config.model, "input": [{"role": "user", "content": content}]}
        if schema := answer_schema(self.kind, self.topic_ids, self.answer_ids):
            out["text"] = {"format": {"type": "json_schema", "name": self.kind, "strict": True, "schema": schema}}
        if self.config.effort:
            out["reasoning"] = {"effort": self.config.effort}
        elif self.temperature is not None:
            out["temperature"] = self.temperature
        return out

    def __call__(self, prompt: str) -> str | None:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.config.api_key}"}
        got = json.loads(self.send(f"{(self.config.base_url or '').rstrip('/')}/responses", json.dumps(self.body(prompt)).encode(), headers, self.config.timeout))
        parts = [c for item in got.get("output", []) if item.get("type") == "message" for c in item.get("content", [])]
        if got.get("status") != "completed" or any(c.get("type") == "refusal" for c in parts):
            return None  # read as an invalid answer
        return "".join(c.get("text", "") for c in parts if c.get("type") == "output_text")


@dataclass
class LocalSpeech:
    """A local speech model, loaded at the first call and kept."""

    config: ProviderConfig
    load: Callable[[str], Callable[[str, str | None], Mapping]] | None = None
    model: Callable | None = None

    def preflight(self) -> None:
        if self.load is None:
            try:
                importlib.import_module("whisper_timestamped")
            except ImportError:
                raise Configuration("whisper_timestamped is not installed") from None

    def __call__(self, path: str) -> Mapping:
        if self.model is None:
            self.preflight()
            self.model = (self.load or _whisper)(self.config.model)
        return self.model(path, self.config.language)


def _whisper(name: str) -> Callable[[str, str | None], Mapping]:
    whisper = importlib.import_module("whisper_timestamped")
    model = whisper.load_model(name, device="cpu")
    return lambda path, language: whisper.transcribe(model, path, language=language)


@dataclass
class HostedSpeech:
    """A hosted speech service: the audio as a form, the words of the answer typed."""

    config: ProviderConfig
    send: Send = send

    def preflight(self) -> None:
        if not self.config.api_key:
            raise Authentication("no key")

    def __call__(self, path: str) -> Mapping:
        self.preflight()
        fields = {"model_id": self.config.model, "timestamps_granularity": "word"} | ({"language_code": self.config.language} if self.config.language else {})
        with upload_audio(path, self.config.timeout) as audio:
            body, kind = form(fields, Path(audio))
        return json.loads(self.send(self.config.base_url or "https://api.elevenlabs.io/v1/speech-to-text", body, {"Content-Type": kind, "xi-api-key": self.config.api_key or ""}, self.config.timeout))


def form(fields: Mapping[str, str], file: Path) -> tuple[bytes, str]:
    """A multipart body with fields and one file, and its content type."""
    mark = uuid.uuid4().hex
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts += [f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{file.name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode(), file.read_bytes(), f"\r\n--{mark}--\r\n".encode()]
    return b"".join(parts), f"multipart/form-data; boundary={mark}"


@dataclass(frozen=True)
class Service:
    make: Callable
    model: str
    base_url: str | None = None
    key_variable: str | None = None


class Offline:
    """Answers from a table, for tests and dry runs; what it lacks it answers by a rule."""

    def __init__(self, answers: Mapping[str, object] | None = None, rule: Callable[[str], object] = lambda prompt: ""):
        self.answers, self.rule = dict(answers or {}), rule

    def __call__(self, prompt: str):
        return self.answers[prompt] if prompt in self.answers else self.rule(prompt)


#: Services, their default models, addresses and the variables with their keys.
LANGUAGE: dict[str, Service] = {
    "ollama": Service(Ollama, "gemma2", "http://localhost:11434"),
    "openai": Service(OpenAI, "gpt-6-luna", "https://api.openai.com/v1", "OPENAI_API_KEY"),
    "offline": Service(lambda config, **_: Offline(), "none"),
}
SPEECH: dict[str, Service] = {
    "whisper_local": Service(LocalSpeech, "base"),
    "elevenlabs": Service(HostedSpeech, "scribe_v2", None, "ELEVENLABS_API_KEY"),
    "offline": Service(lambda config, **_: Offline(), "none"),
}


def service(services: Mapping[str, Service], name: str) -> Service:
    if name not in services:
        raise Configuration(f"unknown provider {name}")
    return services[name]


def client(services: Mapping[str, Service], config: ProviderConfig, **options):
    """A client of the configured service. Pass functools.partial of this to the operators that make clients in tasks."""
    return service(services, config.provider).make(config, **options)


def pair(language: ProviderConfig, speech: ProviderConfig):
    """Both clients; neither loads a model yet."""
    return client(LANGUAGE, language), client(SPEECH, speech)


def checked_speech(config: ProviderConfig, languages: set[str] | None = None, aliases: Mapping[str, str] | None = None) -> ProviderConfig:
    """The configuration, with the language in the form the model knows; what no model takes is an error."""
    from dataclasses import replace

    if not isinstance(config.model, str) or not BLANKS.sub("", config.model):
        raise Configuration("a speech model must be named")
    if config.language is None:
        return config
    low = config.language.lower() if isinstance(config.language, str) else ""
    if not (2 <= len(low) <= 3 and low.isascii() and low.isalpha()):
        raise Configuration("a language is a code of two or three letters")
    if languages is not None and low not in languages:
        low = (aliases or {}).get(low, "")
        if low not in languages:
            raise Configuration("the model does not know this language")
    return replace(config, language=low)
