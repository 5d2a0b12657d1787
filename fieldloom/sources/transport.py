"""Getting a response: bounded attempts, full-jitter waits, Retry-After. How bytes travel is given by the caller."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from fieldloom.errors import TransportError

#: Statuses after which another attempt may help, and the waits in seconds.
RETRIED = frozenset({408, 429, 500, 502, 503, 504})
ATTEMPTS, BASE_WAIT, LONGEST_WAIT = 3, 0.5, 8.0


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes = b""
    headers: Mapping[str, str] = field(default_factory=dict)

    def header(self, name: str) -> str:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), "")


class Budget:
    """Attempts a run may make in all; each is reserved before it is made."""

    def __init__(self, most: int):
        self.most, self.made = most, 0

    def reserve(self) -> int:
        if self.made >= self.most:
            raise TransportError(f"the run's {self.most} attempts are used up")
        self.made += 1
        return self.made


def retry_after(text: str, now: float) -> float | None:
    """Seconds to wait by a Retry-After header of seconds or an HTTP date; None where it says neither."""
    if text.strip().isdigit():
        return float(text)
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - now)
    except (TypeError, ValueError):
        return None


def wait(attempt: int, said: float | None, chance: Callable[[], float] = random.random) -> float:
    """Before the next attempt: what the server said, or a random share of a limit that doubles."""
    return said if said is not None else chance() * min(LONGEST_WAIT, BASE_WAIT * 2 ** (attempt - 1))


def get(
    send: Callable[[str, Mapping, Mapping], Answer], path: str, parameters: Mapping, *, headers: Mapping | None = None, attempts: int = ATTEMPTS, budget: Budget | None = None,
    sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time, chance: Callable[[], float] = random.random,
) -> Answer:
    """send(path, parameters, headers) until it answers. Timeouts, lost connections, cut-off bodies and RETRIED statuses are tried again; 304 is an answer."""
    for attempt in range(1, attempts + 1):
        if budget:
            budget.reserve()
        said = None
        try:
            a = send(path, parameters, headers or {})
            if a.status in (200, 304):
                return a
            failure = TransportError(f"{path}: status {a.status}", a.status, a.status in RETRIED)
            said = retry_after(a.header("Retry-After"), now())
        except (TimeoutError, ConnectionError, EOFError) as e:
            failure = TransportError(f"{path}: {type(e).__name__}", 0, True)
        if not failure.retryable or attempt == attempts:
            raise failure
        sleep(wait(attempt, said, chance))
    raise TransportError(f"{path}: no attempt was allowed")
