"""Python workers outlive their tasks: what one task's work arrays took stays with the process until the next that
needs it, while other workers of the executor need theirs. This hands it back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(of: Batches) -> Batches:
    """`of`, which at the end of its task returns unused memory to the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that has it
        if trim:
            trim(0)

    return run
