"""Retry of driver-side operations with capped exponential backoff."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from itertools import chain
from typing import TypeVar

T = TypeVar("T")


def delays(base: float, cap: float, jitter: bool = False) -> Iterator[float]:
    """Waits without end: from base on, each twice the one before, at most cap; jitter scales by 0.5 to 1.5, past the cap too."""
    wait = base
    while True:
        yield min(wait, cap) * (random.uniform(0.5, 1.5) if jitter else 1)
        wait = min(2 * wait, max(cap, base))


def delay(attempt: int, base: float, cap: float, jitter: bool = False) -> float:
    """The wait after attempt number `attempt` (from 0)."""
    return next(wait for k, wait in enumerate(delays(base, cap, jitter)) if k == attempt)


def retry(operation: Callable[[], T], max_retries: int = 5, base: float = 1.0, cap: float = 60.0, jitter: bool = True, sleep: Callable[[float], None] = time.sleep) -> T | None:
    """The operation's result; the last error if every attempt fails; None for no attempts."""
    failed = None
    # a wait comes before each attempt but the first
    for wait, _ in zip(chain([0.0], delays(base, cap, jitter)), range(max_retries)):
        if failed is not None:
            sleep(wait)
        try:
            return operation()
        except Exception as e:  # kept, and raised if it was the last
            failed = e
    if failed is not None:
        raise failed
    return None
