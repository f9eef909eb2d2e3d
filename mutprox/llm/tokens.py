"""Small helpers shared by the operators on texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


class Memo(dict):
    """Bounded memory of a pure function of one string: two generations of ``most`` entries, and no string above ``longest`` characters."""

    def __init__(self, of: Callable, most: int, longest: int = 1 << 62) -> None:
        super().__init__()
        self.of, self.most, self.longest = of, most, longest
        self.old: dict = {}

    def __missing__(self, key: str):  # noqa: ANN204
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of at most ``rows`` rows: what a step makes of a batch stays small without a session setting."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
