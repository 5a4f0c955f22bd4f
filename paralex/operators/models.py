"""The boundary to models: protocols, providers, and calls from executors.

A model is made by a callable, once a task.  Remote chat models speak the public chat
completion protocol over HTTP, with nothing but the standard library.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.session import written


class Translator(Protocol):
    def generate(self, prompt: str) -> str:
        """The answer to a prompt."""


class BatchTranslator(Protocol):
    def generate_many(self, prompts: list[str]) -> list[str]:
        """The answers to a batch of prompts, in order."""


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]:
        """One vector a text."""


@dataclass(frozen=True)
class Decoding:
    """How a local model makes its answers; a provider reads what it knows of these."""

    max_length: int = 256
    num_beams: int = 1
    do_sample: bool = False
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 1.0
    batch_size: int = 16


class EchoTranslator:
    """Offline stand-in: answers with the text asked for, as JSON."""

    def generate(self, prompt: str) -> str:
        question = prompt.rsplit("\n", 1)[0].rsplit("\n\n", 1)[-1]
        return json.dumps({"translation": question.split(": ", 1)[-1]}, ensure_ascii=False)

    def generate_many(self, prompts: list[str]) -> list[str]:
        return [self.generate(p) for p in prompts]


#: Where each provider is reached and which variable holds its key.
BASE_URLS = {"gpt": "https://api.openai.com/v1/", "gemini": "https://generativelanguage.googleapis.com/v1beta/openai/"}
KEY_VARIABLES = {"gpt": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY"}
#: A request's temperature and its most tokens.
TEMPERATURE, MAX_TOKENS = 0.0, 1_000


def credential(name: str, required: bool = True) -> str | None:
    """The key of a provider from the environment; without it, an error if it is ``required``."""
    value = os.environ.get(KEY_VARIABLES[name])
    if required and not value:
        raise KeyError(KEY_VARIABLES[name])
    return value


@dataclass
class ChatTranslator:
    """A remote chat model: one user message, an answer in JSON mode."""

    model: str
    base_url: str = BASE_URLS["gpt"]
    key: str | None = field(default=None, repr=False)
    timeout: float = 120.0
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS
    #: Variable of the environment that holds the key where the model runs, so that the key itself isn't sent.
    key_variable: str | None = None

    def __post_init__(self):
        if self.key is None and self.key_variable:
            self.key = os.environ.get(self.key_variable)

    def body(self, prompt: str) -> dict:
        return {
            "model": self.model,
            "messages": [{"role": "user", "content": prompt}],
            "response_format": {"type": "json_object"},
            "temperature": self.temperature,
            "max_tokens": self.max_tokens,
        }

    def generate(self, prompt: str) -> str:
        head = {"Content-Type": "application/json"}
        if self.key:
            head["Authorization"] = f"Bearer {self.key}"
        url = self.base_url.rstrip("/") + "/chat/completions"
        request = urllib.request.Request(url, json.dumps(self.body(prompt)).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer_text(json.load(answer))


def answer_text(response: dict) -> str:
    """The first choice's text of a chat completion; an answer without text is the empty string."""
    choices = response.get("choices") or [{}]
    return (choices[0].get("message") or {}).get("content") or ""


def translator(model: str, base_url: str | None = None) -> Callable[[], Translator]:
    """What makes the translator for a model's name: one provider needs a key, the other may
    do without; ``base_url`` names another place that speaks the same protocol.

    Tasks read the key from the environment of their executor; only the variable's name travels.
    """
    name = provider_of(model)
    credential(name, required=name == "gpt" and base_url is None)
    return partial(ChatTranslator, model, base_url or BASE_URLS[name], key_variable=KEY_VARIABLES[name])


def provider(model: Column) -> Column:
    """``gemini`` is looked for before ``gpt``; any other name is null."""
    return F.when(model.contains("gemini"), "gemini").when(model.contains("gpt"), "gpt")


def provider_of(model: str) -> str:
    for name in ("gemini", "gpt"):
        if name in model:
            return name
    raise ValueError(f"unsupported model: {model}")


def _with_answers(rows: DataFrame, work) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInPandas(work, ", ".join([*fields, "response string", "error string"]))


#: Answers of a server that the same call may not get again, and the longest wait.
PASSING = {408, 409, 425, 429, 500, 502, 503, 504}
LONGEST_WAIT = 300.0


def _pause(error: Exception, wait: float, tries: int) -> float | None:
    """Seconds until the next try: what the server says, else twice as long each time.  None: no other try helps."""
    said = None
    if isinstance(error, urllib.error.HTTPError):
        if error.code not in PASSING:
            return None
        said = (error.headers or {}).get("Retry-After")
    try:
        return min(LONGEST_WAIT, max(0.0, float(said)))
    except (TypeError, ValueError):  # nothing is said, or a date
        return min(LONGEST_WAIT, wait * 2**tries)


def _tried(call: Callable, retries: int, wait: float):
    """``(result, None)``, or ``(None, error)`` when every try failed."""
    for tries in range(retries + 1):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001
            pause = _pause(e, wait, tries)
            if tries == retries or pause is None:
                return None, repr(e)
            time.sleep(pause)


def generate(
    rows: DataFrame, make: Callable[[], Translator], prompt: str = "prompt", workers: int = 8, retries: int = 2, wait: float = 1.0, ledger: Ledger | None = None
) -> DataFrame:
    """``rows`` with ``response`` and ``error``.

    ``make`` runs once a task; calls run on ``workers`` threads, since they wait.
    A row whose calls all fail has an error instead of stopping the job.  With a ``ledger``
    each different prompt is asked once, and not at all if it holds the answer.
    """
    if ledger:
        return ledger.generate(rows, lambda some: generate(some, make, prompt, workers, retries, wait), prompt, workers)

    def work(frames):
        model = make()
        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                got = list(pool.map(lambda t: _tried(lambda: model.generate(t), retries, wait), f[prompt]))
                yield f.assign(response=pd.Series([g[0] for g in got], f.index, dtype=object), error=pd.Series([g[1] for g in got], f.index, dtype=object))

    return _with_answers(rows, work)


class Ledger:
    """Answers of one model, kept in a folder by prompt.

    Answers are asked for by small tasks, and what a task wrote stays when it ends, even if
    the run is stopped before its other tasks do.  So the next run asks only what has no
    answer yet: what failed, and what the tasks that were cut off had asked.
    """

    #: Prompts of one task for each thread.
    ROUNDS = 4
    SCHEMA = "key string, model string, prompt string, response string, error string, at timestamp"

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def _key(self, prompt: str) -> Column:
        return F.sha2(F.concat(F.lit(self.model), F.lit("\0"), F.coalesce(F.col(prompt), F.lit(""))), 256)

    def entries(self) -> DataFrame:
        """``key, response, error`` of each prompt: its answer, or the error of its last try."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], "key string, response string, error string")
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = F.max(F.struct(F.col("error").isNull().alias("good"), "at", "response", "error")).alias("e")
        return rows.filter(F.col("model") == self.model).groupBy("key").agg(last).select("key", "e.response", "e.error")

    def generate(self, rows: DataFrame, ask: Callable[[DataFrame], DataFrame], prompt: str, workers: int) -> DataFrame:
        known = self.entries().filter("error is null").select(F.col("key").alias("_key"))
        wanted = rows.select(self._key(prompt).alias("_key"), F.col(prompt)).dropDuplicates(["_key"])
        missing = written(wanted.join(known, "_key", "left_anti"))
        n = missing.count()
        if n:
            tasks = -(-n // (self.ROUNDS * workers))
            got = ask(missing.repartition(tasks, "_key"))
            out = got.select(F.col("_key").alias("key"), F.lit(self.model).alias("model"), F.col(prompt).alias("prompt"), "response", "error", F.current_timestamp().alias("at"))
            # What a task writes is in its place when the task ends, not when the whole job does.
            out.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        held = written(self.entries()).withColumnRenamed("key", "_key")
        return rows.withColumn("_key", self._key(prompt)).join(held, "_key", "left").drop("_key")


def generate_batches(
    rows: DataFrame, make: Callable[[Decoding], BatchTranslator], prompt: str = "prompt", decoding: Decoding = Decoding(), retries: int = 0
) -> DataFrame:
    """As ``generate``, for local models that answer ``decoding.batch_size`` prompts at a time.

    ``make`` gets the decoding options once a task.  Answers keep the order of the
    prompts; a batch that fails has the same error in all its rows, and an answer too few
    or too many is an error.
    """

    def work(frames):
        model = make(decoding)

        def answers(prompts: list[str]) -> list[str]:
            out = model.generate_many(prompts)
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            return out

        for f in frames:
            asked, got = f[prompt].tolist(), []
            for at in range(0, len(asked), decoding.batch_size):
                part = asked[at : at + decoding.batch_size]
                out, error = _tried(lambda: answers(part), retries, 0.0)
                got += [(None, error)] * len(part) if out is None else [(x, None) for x in out]
            yield f.assign(response=pd.Series([g[0] for g in got], f.index, dtype=object), error=pd.Series([g[1] for g in got], f.index, dtype=object))

    return _with_answers(rows, work)


def encode(rows: DataFrame, make: Callable[[], Encoder], text: str = "text_source", vector: str = "embedding", batch_size: int = 64) -> DataFrame:
    """``rows`` with the vector of each text; a null text has a null vector.

    ``make`` runs once a task, and the encoder gets ``batch_size`` texts at a time.
    """

    def work(series):
        model = make()
        for texts in series:
            out: list = [None] * len(texts)
            real = [i for i, t in enumerate(texts) if t is not None]
            values = texts.tolist()
            for at in range(0, len(real), batch_size):
                here = real[at : at + batch_size]
                for i, v in zip(here, model.encode([values[i] for i in here])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    from collections.abc import Iterator

    def typed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return work(series)

    typed.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(vector, F.pandas_udf(typed, "array<double>")(F.col(text)))


class HashEncoder:
    """Offline stand-in for an encoder: words hashed to ``size`` components, scaled to length one."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            row = [0.0] * self.size
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[code % self.size] += 1.0 if code >> 16 & 1 else -1.0
            norm = sum(x * x for x in row) ** 0.5
            out.append([x / norm for x in row] if norm else row)
        return out


#: Most wanted tokens that are sent along.
SENT_TOKENS = 1_000_000


def missing_tokens(wanted: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Wanted tokens that the vocabulary lacks.

    The vocabulary may be a whole corpus.  Up to ``SENT_TOKENS`` wanted tokens are sent to
    where it is, so that only what is met of these is moved; more meet its different tokens.
    """
    known, some = vocabulary.select(token), wanted.select(token)
    if some.count() <= SENT_TOKENS:
        met = known.join(F.broadcast(some), token, "left_semi").distinct()
        return wanted.join(F.broadcast(met), token, "left_anti")
    return wanted.join(known.distinct().join(some, token, "left_semi"), token, "left_anti")
