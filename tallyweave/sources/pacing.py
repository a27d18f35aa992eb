"""Calls to a provider kept within a budget of tokens a minute, in one process."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class Pacer:
    """Keeps the moment at which all tokens given so far will have been earned. A minute's worth may go out at once; a call is let through when its
    tokens are earned by now. An amount above a minute's worth counts as that."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.most, self.clock = max(1, per_minute) / 60, float(max(1, per_minute)), clock
        self.earned_at = clock() - 60
        self.lock = threading.Lock()

    def _move(self, tokens: float, now: float) -> None:
        self.earned_at = min(max(self.earned_at, now - 60) + tokens / self.rate, now)

    def delay(self, tokens: float) -> float:
        """Takes the tokens and gives 0, or the seconds until they are there."""
        tokens = min(max(1.0, float(tokens)), self.most)
        with self.lock:
            now = self.clock()
            after = max(self.earned_at, now - 60) + tokens / self.rate
            if after > now + 1e-9:
                return after - now
            self.earned_at = min(after, now)
            return 0.0

    def acquire(self, tokens: float, sleep: Callable[[float], None] = time.sleep) -> None:
        while wait := self.delay(tokens):
            sleep(min(max(wait, 0.01), 2.0))

    def settle(self, reserved: float, used: float) -> None:
        """Gives back what a call did not use, or takes what it used beyond."""
        with self.lock:
            self._move(used - reserved, self.clock())

    @property
    def left(self) -> float:
        now = self.clock()
        return (now - max(self.earned_at, now - 60)) * self.rate
