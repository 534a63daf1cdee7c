"""Settings from a properties file, with the environment before it."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def _properties(path: str | None) -> dict[str, str]:
    if not path or not Path(path).exists():
        return {}
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and x[0] not in "#!")}


@dataclass(frozen=True)
class Settings:
    model_url: str = ""
    model: str = ""
    answer_url: str = ""
    answer_model: str = ""
    embedding_url: str = ""
    embedding_model: str = ""
    window: int = 5
    digest_top: int = 50
    batch_messages: int = 20
    batch_tokens: int = 2000

    @property
    def selects(self) -> bool:
        """Whether digests are chosen by similarity: only with a whole embedding group."""
        return bool(self.embedding_url and self.embedding_model)


def load(path: str | None = None, prefix: str = "LOREKEEP_", env: dict[str, str] | None = None) -> Settings:
    """The environment (``PREFIX_NAME``) overrides the file (``name=value``); blank values count as missing.

    Answer settings fall back to those of the extraction model; a partial embedding group is off.
    """
    env, found = dict(os.environ) if env is None else env, _properties(path)
    values: dict = {}
    for name, field in Settings.__dataclass_fields__.items():
        raw = env.get(prefix + name.upper(), "").strip() or found.get(name, "").strip()
        if raw:
            values[name] = int(raw) if field.type == "int" else raw
    values.setdefault("answer_url", values.get("model_url", ""))
    values.setdefault("answer_model", values.get("model", ""))
    if not (values.get("embedding_url") and values.get("embedding_model")):
        values.pop("embedding_url", None)
        values.pop("embedding_model", None)
    return Settings(**values)
