"""Calls of models, and what became of them.

A call ends in one of OUTCOMES, which is a column that plans branch on: a reply
that was cut off is read again in parts, a used-up quota is told apart from a
failure that passed, and a partial reply is never taken for a whole one."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Any, NamedTuple

from .provider import DAILY, RETRIED, with_retries

FINISHED, TRUNCATED, QUOTA, TRANSPORT, OTHER = OUTCOMES = ("finished", "truncated", "quota", "transport", "other")
#: The reasons that providers give for a reply that is whole, or cut off.
WHOLE, CUT_OFF = (None, "stop", "tool_calls"), "length"
FENCED = re.compile(r"```[A-Za-z]*\s*\n?(.*?)\s*```", re.S)


class Reply(NamedTuple):
    """A model's words, and why it ended."""

    content: str | None
    finish: str | None = None


class Outcome(NamedTuple):
    outcome: str
    reply: str | None
    error: str | None
    calls: int


OUTCOME = "outcome string, reply string, error string, calls int"


def failure(error: Exception) -> str:
    said = f"{type(error).__name__}: {error}"
    return QUOTA if DAILY.search(said) else TRANSPORT if RETRIED.search(said) else OTHER


def attempted(call: Callable[[], Reply | str], attempts: int = 2, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """The outcome of call(), which is made again after failures that pass."""
    made = 0

    def once() -> Reply | str:
        nonlocal made
        made += 1
        return call()

    try:
        said = with_retries(once, attempts, pause, sleep)
    except Exception as e:
        return Outcome(failure(e), None, str(e) or type(e).__name__, made)
    content, finish = said if isinstance(said, Reply) else Reply(said)
    if finish == CUT_OFF:
        return Outcome(TRUNCATED, None, "the reply was cut off", made)
    if finish not in WHOLE:
        return Outcome(OTHER, None, f"the model stopped for another reason: {finish}", made)
    if not (content or "").strip():
        return Outcome(OTHER, None, "the reply is empty", made)
    return Outcome(FINISHED, content, None, made)


def json_object(text: str) -> dict:
    """The object of a reply, fenced or not."""
    fenced = FENCED.search(text)
    out = json.loads(fenced[1] if fenced else text.strip())
    if not isinstance(out, dict):
        raise ValueError("the reply is no JSON object")
    return out


def structured(call: Callable[[], Any], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The object that call() gives, as a dict or as a reply's text; what can't
    be read as one is an error, and isn't asked for again."""
    said = with_retries(call, attempts, pause, sleep)
    if isinstance(said, dict):
        return said
    content, finish = said if isinstance(said, Reply) else Reply(said)
    if finish not in WHOLE:
        raise ValueError(f"the reply isn't whole: {finish}")
    return json_object(content or "")
