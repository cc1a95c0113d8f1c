"""Settings from the environment; a value that can't be read is its default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


def number(text: str | None, default: float, least: float | None = None) -> float:
    try:
        value = type(default)(text)
    except (TypeError, ValueError):
        return default
    return default if least is not None and value < least else value


def flag(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    provider: str = "offline"
    cache_least_confidence: float = 0.90
    store_least_confidence: float = 0.90
    max_attempts: int = 2
    retries: int = 3
    store_enabled: bool = True

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        d = cls()
        return cls(env.get("PAPERLOOM_PROVIDER", d.provider), number(env.get("PAPERLOOM_CACHE_LEAST_CONFIDENCE"), d.cache_least_confidence), number(env.get("PAPERLOOM_STORE_LEAST_CONFIDENCE"), d.store_least_confidence), int(number(env.get("PAPERLOOM_MAX_ATTEMPTS"), d.max_attempts, 1)), int(number(env.get("PAPERLOOM_RETRIES"), d.retries, 1)), flag(env.get("PAPERLOOM_STORE"), d.store_enabled))
