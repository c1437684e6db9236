"""Settings of a run from the session's configuration (``spark.folioworks.<name>``), with defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from ..fixed_values import MAX_CHARS, MAX_TOKENS, RATE_PER_MINUTE

PREFIX = "spark.folioworks."


def json_list(value: str | None, default: list[str]) -> list[str]:
    """A list of texts written as JSON; ``default`` where it is missing or no such list."""
    try:
        found = json.loads(value) if value is not None else default
    except json.JSONDecodeError:
        return default
    return found if isinstance(found, list) and all(isinstance(x, str) for x in found) else default


@dataclass(frozen=True)
class Settings:
    """Limits of chunks and of requests, and the sources whose documents are taken (none named: all)."""

    max_chunk_chars: int = MAX_CHARS
    max_chunk_tokens: int = MAX_TOKENS
    enforce_cap: bool = False
    rate_per_minute: int = RATE_PER_MINUTE
    sources: tuple[str, ...] = ()

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Read them; a value that is no number, or no list, counts as not set."""
        out = {}
        for field in fields(cls):
            value = spark.conf.get(PREFIX + field.name, None)
            if value is None:
                continue
            if field.name == "sources":
                out[field.name] = tuple(json_list(value, []))
            elif field.name == "enforce_cap":
                out[field.name] = value.strip().lower() == "true"
            elif value.strip().isdigit():
                out[field.name] = int(value)
        return cls(**out)
