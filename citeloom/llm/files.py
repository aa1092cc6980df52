"""Files of the shared folder as seen from Python workers, and work over sorted byte ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the plain path of a URI; a path without scheme is local."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def writer(path: str) -> pa.NativeFile:
    where, plain = opened(path)
    return where.open_output_stream(plain, compression=None)


def reader(path: str) -> pa.NativeFile:
    """Random access; a local file is mapped into memory, so that reads copy nothing."""
    where, plain = opened(path)
    return pa.memory_map(plain) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(plain)


def coalesced(ranges: Iterable[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, indices) of reads that cover sorted (offset, length) ranges.

    Neighbours join if at most ``gap`` bytes lie between them and the read stays
    within ``most`` bytes; a longer single range is a read of its own.
    """
    start = end = None
    held: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if held and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield start, end, held
