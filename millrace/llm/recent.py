"""What a worker remembers of its own work, within bounds; results never depend on it."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """A mapping of about ``size`` entries at most: of those made longest ago the ones not asked for since are forgotten."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
