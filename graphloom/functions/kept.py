"""Values that are made again and again."""

from __future__ import annotations


class Kept(dict):
    """What make() gives for short keys, kept for up to MOST of them."""

    MOST, LONGEST = 1 << 17, 64

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[key] = value
        return value
