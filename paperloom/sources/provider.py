"""Model providers behind one interface, with offline ones.

There is no network here: real providers are registered by who has one. The
stub answers deterministically from the question's text; no provider here reads
figures. Replies may be texts or objects, or calls.Reply with the reason that
the model ended.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Any, Protocol

#: What failures say that pass, that don't before the quota's next period, and how long to wait.
RETRIED = re.compile(r"429|rate_limit|timeout|timed out|temporar|50[234]", re.I)
DAILY = re.compile(r"tokens per day|\bTPD\b|requests per day|\bRPD\b|monthly", re.I)
WAIT_HINT = re.compile(r"try again in ([0-9.]+)\s*s", re.I)
LONGEST_WAIT = 60.0


class CapabilityUnavailable(RuntimeError):
    """No such provider, model or key here."""


class Provider(Protocol):
    def plan(self, item: dict) -> dict: ...
    def solve(self, item: dict) -> dict: ...
    def review(self, item: dict, solution: dict) -> dict: ...
    def read_image(self, image: bytes, page: int) -> Any: ...
    def interpret_figure(self, image: bytes) -> str: ...


class OfflineProvider:
    """Plausible, repeatable replies. Items whose number is divisible by
    `weak_every` fail their first review and pass the second."""

    def __init__(self, weak_every: int = 5):
        self.weak_every = weak_every

    def plan(self, item: dict) -> dict:
        return {"complexity": "moderate", "model_tier": "standard", "needs_vision": False}

    def solve(self, item: dict) -> dict:
        if not (item.get("text") or "").strip():
            raise ValueError("there is no text to solve")
        marks = item.get("marks")
        marks = None if marks is None or marks != marks else int(marks)
        return {"answer": f"Answer to {item['number']}", "steps": ["Read the question.", "State the result."], "mark_split": [{"marks": marks, "for": "result"}] if marks else [], "common_mistakes": []}

    def review(self, item: dict, solution: dict) -> dict:
        n = int(re.sub(r"\D", "", str(item["number"])) or 0)
        good = bool(n % self.weak_every) or int(item.get("attempts") or 0) > 0
        return {"passed": good, "correctness": 0.95 if good else 0.5, "answer_review_passed": good, "independent_check_passed": good}

    def read_image(self, image: bytes, page: int) -> str:
        return '{"metadata": {}, "questions": []}'

    def interpret_figure(self, image: bytes) -> str:
        raise CapabilityUnavailable("no model here reads figures")


class NoProvider:
    """None of the capabilities."""

    def __getattr__(self, name: str) -> Callable[..., Any]:
        if name.startswith("__"):
            raise AttributeError(name)
        raise CapabilityUnavailable(f"no model was given that could {name.replace('_', ' ')}")


class LineReader(OfflineProvider):
    """Reads pages that are texts in UTF-8: each line is a question, its number
    stands before the first tab. Its replies end after `most_lines` lines, as a
    model's do after so many tokens."""

    def __init__(self, most_lines: int = 40, **options: Any):
        super().__init__(**options)
        self.most_lines = most_lines

    def read_image(self, image: bytes, page: int):
        from .calls import CUT_OFF, Reply

        lines = image.decode().split("\n")
        items = [dict(zip(("question_number", "question_text"), (*x.split("\t", 1), ""))) for x in lines[: self.most_lines]]
        return Reply(json.dumps({"metadata": {}, "questions": items}, ensure_ascii=False), CUT_OFF if len(lines) > self.most_lines else "stop")


REGISTRY: dict[str, Callable[..., Provider]] = {"offline": OfflineProvider, "lines": LineReader}


def register(name: str, make: Callable[..., Provider]) -> None:
    REGISTRY[name] = make


def provider(name: str, **options: Any) -> Provider:
    if name not in REGISTRY:
        raise CapabilityUnavailable(f"no provider named {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


def generate_image(*_: Any) -> bytes:
    """No provider makes images."""
    raise CapabilityUnavailable("image generation isn't available")


def with_retries(call: Callable[[], Any], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after a passing failure: a longer pause each time, or what
    the failure asks for up to LONGEST_WAIT. A used-up daily quota doesn't pass."""
    for k in range(1, max(1, attempts) + 1):
        try:
            return call()
        except Exception as e:
            if k >= attempts or not RETRIED.search(f"{type(e).__name__}: {e}") or DAILY.search(str(e)):
                raise
            hint = WAIT_HINT.search(str(e))
            sleep(min(LONGEST_WAIT, float(hint[1]) + 0.5 if hint else pause * k))
