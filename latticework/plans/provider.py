"""Providers of asset understanding, their settings, and the persistent answer cache."""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import enrich
from ..session import ship
from . import exports

# Provider names, defaults and environment overrides.
PROVIDERS = ("mock", "openai", "local")
DEFAULT_KEY_ENV = "OPENAI_API_KEY"
PROMPT_VERSION = "1.0"
PROMPTS = {"understand": f'Look at this 2D game asset and answer with one JSON object only: "assetType" ({", ".join(enrich.ASSET_TYPES)}), "category" (short), "description" (one sentence), "confidence" (0 to 1). Judge by the pixels, not by the file name.'}


class ProviderError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Provider(Protocol):
    """What answers a request; must be picklable, as it runs where the rows are."""

    id: str
    model: str

    def answer(self, name: str, prompt: str) -> str: ...


@dataclass
class Scripted:
    """Canned answers in order, the last one again and again; an exception is raised. For tests."""

    answers: tuple
    id: str = "scripted"
    model: str = "scripted-1"
    calls: int = 0

    def answer(self, name: str, prompt: str) -> str:
        out = self.answers[min(self.calls, len(self.answers) - 1)]
        self.calls += 1
        if isinstance(out, Exception):
            raise out
        return out


def _post(url: str, headers: dict[str, str], body: bytes) -> tuple[int, bytes]:
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, body, headers, method="POST"), timeout=60) as r:
            return r.status, r.read()
    except error.HTTPError as e:
        return e.code, b""


@dataclass
class Hosted:
    """A model behind a chat-completions endpoint at `base`. Nothing uses it unless it is passed in; `send`
    (url, headers, body) -> (status, body) can be replaced, so tests need no network."""

    base: str
    key: str
    model: str
    send: Callable[[str, dict[str, str], bytes], tuple[int, bytes]] = _post
    id: str = "openai"

    def answer(self, name: str, prompt: str, image: bytes | None = None) -> str:
        content = [{"type": "text", "text": prompt}]
        if image is not None:
            content.append({"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(image).decode()}"}})
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": content}]}).encode()
        try:
            status, said = self.send(f"{self.base.rstrip('/')}/chat/completions", {"content-type": "application/json", "authorization": f"Bearer {self.key}"}, body)
        except OSError as e:
            raise ProviderError("AI_PROVIDER_FAILED", f"request failed: {e}") from e
        if not 200 <= status < 300:
            raise ProviderError("AI_PROVIDER_FAILED", f"HTTP {status} from provider")
        try:
            text = json.loads(said)["choices"][0]["message"]["content"]
        except (ValueError, LookupError, TypeError):
            text = None
        if not isinstance(text, str):
            raise ProviderError("AI_PROVIDER_FAILED", "response has no message content")
        return text


@dataclass
class Reserved:
    """The place of a local model; every call fails."""

    id: str = "local"
    model: str = "local-reserved"

    def answer(self, name: str, prompt: str) -> str:
        raise ProviderError("AI_LOCAL_NOT_IMPLEMENTED", "the local provider is reserved; use mock or pass a Provider")


@dataclass(frozen=True)
class Settings:
    enabled: bool = False
    provider: str = "mock"
    model: str | None = None
    key_env: str = DEFAULT_KEY_ENV
    prompt_version: str = PROMPT_VERSION

    @classmethod
    def resolve(cls, raw: Mapping | None = None, env: Mapping[str, str] | None = None) -> Settings:
        """Given values, with AI_PROVIDER and AI_ENABLED over them and AI_MODEL where no model is given."""
        raw, env = raw or {}, os.environ if env is None else env
        provider = raw.get("provider", "mock")
        if provider not in PROVIDERS:
            raise ProviderError("AI_CONFIG_INVALID", f"provider must be one of {', '.join(PROVIDERS)}")
        if env.get("AI_PROVIDER") in PROVIDERS:
            provider = env["AI_PROVIDER"]
        enabled = env["AI_ENABLED"] in ("true", "1") if "AI_ENABLED" in env else bool(raw.get("enabled", False))
        return cls(enabled, provider, raw.get("model") or env.get("AI_MODEL"), raw.get("apiKeyEnv", DEFAULT_KEY_ENV), raw.get("promptVersion", PROMPT_VERSION))


def answer_column(settings: Settings, name) -> object:
    """The answer as a Column expression. Only the mock provider is built; it is always allowed."""
    if settings.provider == "mock":
        return enrich.mock_response(name)
    if not settings.enabled:
        raise ProviderError("AI_DISABLED", f"provider {settings.provider} is not enabled")
    raise ProviderError("AI_NOT_AVAILABLE", f"provider {settings.provider} is not part of this engine; pass a Provider")


def ask(requests: DataFrame, provider: Provider, kind: str = "understand") -> DataFrame:
    """(key, name, value, error) for requests (key, name, and png if there is one): one call a row, failures as rows."""
    prompt, pictures = PROMPTS[kind], "png" in requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = (batch.column(i).to_pylist() for i in (0, 1))
            values, errors = [], []
            for n, name in enumerate(names):
                try:
                    values.append(provider.answer(name, prompt, *([batch.column(2)[n].as_py()] if pictures else [])))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a provider is a row
                    values.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (keys, names, values, errors)], names=["key", "name", "value", "error"])

    ship(requests.sparkSession)
    return requests.select("key", "name", *(["png"] if pictures else [])).mapInArrow(run, "key string, name string, value string, error string")


def keyed(assets: DataFrame, settings: Settings, model: str = "mock-1") -> DataFrame:
    """key, name for assets (name, hash): the cache key holds provider, model, prompt version, pixels and name."""
    key = S.cache_key(F.lit(settings.provider), F.lit(settings.model or model), F.lit(settings.prompt_version), F.col("hash"), F.col("name"))
    return assets.select(key.alias("key"), "name")


class AnswerCache:
    """(key, value) rows in a folder; a missing or unreadable cache is an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.schema("key string, value string").parquet(self.path)
            rows.limit(1).collect()
        except Exception:  # noqa: BLE001  unreadable: answers are asked for again
            return self.spark.createDataFrame([], "key string, value string")
        return rows.groupBy("key").agg(F.min("value").alias("value"))

    def add(self, answers: DataFrame) -> None:
        """Append answers that are not there yet."""
        fresh = answers.where("value IS NOT NULL").select("key", "value").join(self.read().select("key"), "key", "left_anti")
        fresh.groupBy("key").agg(F.min("value").alias("value")).write.mode("append").parquet(self.path)


def understand(assets: DataFrame, cache: AnswerCache, settings: Settings, provider: Provider | None = None) -> DataFrame:
    """source, ord, asset_type, category, description, confidence, problems, hit for assets (name, hash).

    Cached answers are validated again; misses are asked for once a key and added to the cache.
    """
    requests = keyed(assets, settings, provider.model if provider else "mock-1")
    held = cache.read()
    missing = requests.join(held.select("key"), "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    if provider:
        new = ask(missing, provider)
    else:
        new = missing.select("key", "name", answer_column(settings, F.col("name")).alias("value"), F.lit(None).cast("string").alias("error"))
    folder = f"{cache.path}-asked-{uuid.uuid4().hex}"
    new.write.parquet(folder)  # asked once, whatever reads it later
    new = _asked(assets.sparkSession, folder)
    cache.add(new)
    known = held.select("key", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("hit")).unionByName(new.select("key", "value", "error", F.lit(False).alias("hit")))
    rows = requests.join(known, "key").withColumn("u", enrich.validate(F.col("value")))
    problems = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("u.problems"))
    return rows.select(F.col("name").alias("source"), F.col("name").alias("ord"), "u.asset_type", "u.category", "u.description", "u.confidence", problems.alias("problems"), "hit")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("key string, name string, value string, error string").parquet(folder)


def sidecars(results: DataFrame, settings: Settings) -> dict[str, Iterator[str]]:
    """The three documents about a run by file name: report, classification and metadata, as JSON in parts.

    Only totals are gathered; rows come partition by partition, by source.
    """
    good, bad = results.where(F.size("problems") == 0), results.where(F.size("problems") > 0)
    meta = enrich.metadata(good)
    rows = lambda df, make: (make(r) for r in df.orderBy("source").toLocalIterator())
    assets, hits = good.agg(F.count(F.lit(1)), F.count_if("hit")).first()

    def report() -> Iterator[str]:
        summary = {"assets": assets, "errors": bad.count(), "cacheHits": hits, "cacheMisses": assets - hits}
        yield exports.opened({"version": 1, "provider": settings.provider, "promptVersion": settings.prompt_version, "summary": summary})
        yield from exports.listed("results", rows(good, lambda r: {"source": r.source, "assetType": r.asset_type, "category": r.category, "description": r.description, "confidence": r.confidence}))
        yield ',\n  "suggestions": {\n'
        yield from exports.listed("naming", rows(meta.where("suggested_name IS NOT NULL"), lambda r: {"source": r.source, "suggestedName": r.suggested_name}), 2)
        yield ",\n"
        yield from exports.listed("pivot", rows(enrich.pivot_suggestions(good), lambda r: {"source": r.source, "pivot": {"x": r.x, "y": r.y}}), 2)
        yield ",\n"
        yield from exports.listed("animation", rows(meta.where(F.size("moves") > 0), lambda r: {"source": r.source, "recommended": r.moves}), 2)
        yield "\n  },\n"
        yield from exports.listed("errors", rows(bad, lambda r: {"source": r.source, "error": "; ".join(r.problems)}))
        yield "\n}\n"

    def one_list(name: str, df: DataFrame, make) -> Iterator[str]:
        yield exports.opened({"version": 1})
        yield from exports.listed(name, rows(df, make))
        yield "\n}\n"

    return {
        "ai_report.json": report(),
        "classification.json": one_list("items", enrich.classification(good), lambda r: {"source": r.source, "suggestedFolder": r.suggested_folder, "assetType": r.asset_type, "category": r.category, "confidence": r.confidence}),
        "asset_metadata.json": one_list("assets", meta, lambda r: {"source": r.source, "name": r.suggested_name, "type": r.asset_type, "category": r.category, "description": r.description, "animationSuggestions": r.moves}),
    }
