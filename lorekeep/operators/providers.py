"""Model calls as column producers: embeddings and completions, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_facts
from ..functions.parsing import readable as readable_json

# Texts per embedding call, temperatures of the first try and of the next ones.
EMBED_BATCH = 32
RETRY_TEMPERATURES = (0.0, 0.3, 0.7)


class Truncated(ValueError):
    """An answer that the model cut off."""


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, system: str, user: str, temperature: float) -> tuple[str, int, int]:
        """The answer, its prompt tokens and its completion tokens."""


class HashEmbedder:
    """Offline: the hashed 3-grams of a text as a unit vector. Texts with common 3-grams are near each other."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        p, v = f"  {' '.join(text.lower().split())} ", [0.0] * self.dimensions
        for k in range(len(p) - 2):
            h = int.from_bytes(hashlib.blake2b(p[k : k + 3].encode(), digest_size=8).digest(), "big")
            v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        if not norm:
            v[0] = norm = 1.0
        return [x / norm for x in v]


class FieldExtractor:
    """Offline: answers with the facts that a batch states as ``subject: ..; attr: ..; value: ..`` fields."""

    _LINE = re.compile(r"^\[(\d+)\] [^:]*: (.*)$")

    def complete(self, system: str, user: str, temperature: float) -> tuple[str, int, int]:
        facts = []
        for line in user.split("\n"):
            if m := self._LINE.match(line):
                f = dict(x.split(":", 1) for x in m[2].split(";") if ":" in x)
                f = {k.strip().lower(): v.strip() for k, v in f.items()}
                if f.get("subject"):
                    facts.append({"kind": "STATE", "subject": f["subject"], "predicate": f.get("attr"), "object": f.get("value"), "statement": m[2], "evidence_ids": [int(m[1])]})
        answer = json.dumps(facts, ensure_ascii=False)
        return answer, len(user) // 4, len(answer) // 4


class HttpModel:
    """A chat and embedding endpoint of the common JSON form, with linear back-off. Needs a network, so it is not covered by tests."""

    def __init__(self, url: str, model: str, key: str = "", dimensions: int = 0, attempts: int = 3, timeout: float = 300.0):
        self.url, self.model, self.key, self.dimensions, self.attempts, self.timeout = url.rstrip("/"), model, key, dimensions, attempts, timeout

    def _post(self, path: str, body: dict) -> dict:
        from urllib.request import Request, urlopen

        for attempt in range(1, self.attempts + 1):
            try:
                request = Request(f"{self.url}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(2.0 * attempt)
        raise AssertionError("unreachable")

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self._post("embeddings", {"model": self.model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def complete(self, system: str, user: str, temperature: float) -> tuple[str, int, int]:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        r = self._post("chat/completions", {"model": self.model, "temperature": temperature, "messages": messages})
        usage = r.get("usage", {})
        if r["choices"][0].get("finish_reason") == "length":
            raise Truncated("the answer was cut off")
        return r["choices"][0]["message"]["content"], usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """(``key``, embedding): one vector for each row, ``batch`` texts a call. Raises on a blank text, a missing vector or another dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            texts, out = f[text].tolist(), []
            if any(t is None or not str(t).strip() for t in texts):
                raise ValueError("blank text to embed")
            for k in range(0, len(texts), batch):
                got = embedder.embed(texts[k : k + batch])
                if len(got) != len(texts[k : k + batch]) or any(len(v) != embedder.dimensions for v in got):
                    raise ValueError("incomplete embeddings")
                out += got
            yield pd.DataFrame({key: f[key].tolist(), "embedding": out})

    chosen = rows.select(key, text)
    return chosen.mapInPandas(run, f"{key} {dict(chosen.dtypes)[key]}, embedding array<double>")


def complete(prompts: DataFrame, key: list[str], system: str, user: str, completer: Completer, readable=None) -> DataFrame:
    """(key, answer, prompt_tokens, completion_tokens, calls): an answer for each prompt.

    ``readable`` judges an answer; one that isn't, or was cut off, is asked for again at a higher temperature. Where the last
    try fails too the job fails, so that no prompt goes without its answer in silence.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            out = []
            for prompt in f[user]:
                asked = given = 0
                for calls, t in enumerate(RETRY_TEMPERATURES, 1):
                    try:
                        answer, p, c = completer.complete(system, prompt, t)
                    except Truncated:
                        continue
                    asked, given = asked + p, given + c
                    if readable is None or readable(answer):
                        break
                else:
                    raise ValueError(f"no readable answer in {len(RETRY_TEMPERATURES)} tries to: {str(prompt)[:200]}")
                out.append((answer, asked, given, calls))
            yield pd.DataFrame({**{k: f[k].tolist() for k in key}, **{n: [o[i] for o in out] for i, n in enumerate(("answer", "prompt_tokens", "completion_tokens", "calls"))}})

    chosen = prompts.select(*key, user)
    kinds = dict(chosen.dtypes)
    return chosen.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", answer string, prompt_tokens long, completion_tokens long, calls int")


def extract(batches: DataFrame, completer: Completer, system: str = "") -> DataFrame:
    """Facts of message batches (first_id, text): one call a batch, asked again if it isn't whole JSON, parsed as ``parse_facts`` says."""
    answers = complete(batches, ["first_id"], system, "text", completer, readable_json)
    return parse_facts(answers, "first_id", "answer")


def with_vectors(table: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """``table`` with the vectors (``key``, embedding) written over those it has; rows without a new one keep theirs."""
    v = vectors.select(F.col(key).alias("_key"), F.col("embedding").alias("_vector"))
    joined = table.join(v, table[key] == v["_key"], "left")
    return joined.select(*[F.coalesce("_vector", F.col(column)).alias(c) if c == column else table[c] for c in table.columns])


def valid_answers(points: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers (point_id, arm, point_fp, ...) that hold: the point exists and its fingerprint is the one they were made with."""
    p = points.select(F.col("point_id").alias("_p"), F.col("point_fp").alias("_fp"))
    return answers.join(p, (F.col("point_id") == F.col("_p")) & (F.col("point_fp") == F.col("_fp")), "left_semi")


def stale_answers(points: DataFrame, answers: DataFrame, most: int | None = None) -> DataFrame:
    """(point_id, arm) still to be generated: those without an answer of the point's current fingerprint.

    ``most`` limits the points worked on in one run, in order of their ids; points with both answers don't count.
    """
    wanted = points.select("point_id", "point_fp", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"))
    open_ = wanted.join(answers.select("point_id", "arm", "point_fp"), ["point_id", "arm", "point_fp"], "left_anti").select("point_id", "arm")
    if most is None:
        return open_
    return open_.join(open_.select("point_id").distinct().orderBy("point_id").limit(most), "point_id", "left_semi")
