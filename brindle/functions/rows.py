"""Python over Arrow text in pieces: what a task holds does not grow with its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows whose texts are Python objects at a time.
PIECE = 256


def pieces(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, ``PIECE`` at a time. Then Arrow gives back what it holds
    unused, which a reused Python worker otherwise keeps."""
    for k in range(0, len(column), PIECE):
        yield column.slice(k, PIECE).to_pylist()
    pa.default_memory_pool().release_unused()


def each(convert: Callable[[str | None], str | None]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``convert`` of every text, for an Arrow UDF; results leave piece by piece."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for texts in pieces(column):
                yield pa.array([convert(x) for x in texts], pa.string())

    return run
