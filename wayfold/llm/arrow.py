"""Small helpers for kernels that run over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa


class Bounded(dict):
    """A memo of a function of one text that is emptied when it holds ``most`` entries; keys over ``longest`` are not kept, so its bytes are bounded, too.

    Lookups of known keys run at dictionary speed, as only misses call Python code.
    """

    def __init__(self, function, most: int, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column one by one, null as empty, without a Python list of them all."""
    for value in column:
        yield value.as_py() or b""


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(table: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)
