"""Functions from rows to Arrow, a chunk of rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Characters of a function's first argument in a chunk.
CHUNK_CHARS = 1 << 20


def size(value) -> int:
    return 0 if value is None else len(value) if isinstance(value, str) else sum(len(x) for x in value if x is not None)


def by_chunks(of: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """of(*values) of each row. Python objects are made and given up chunk by chunk: a worker holds the batch and
    its result as Arrow, and besides them about CHUNK_CHARS of values (a longer one alone)."""
    parts, out, held = [], [], 0
    for row in zip(*columns, strict=True):
        values = [x.as_py() for x in row]
        out.append(of(*values))
        held += size(values[0])
        if held >= CHUNK_CHARS:
            parts.append(pa.array(out, kind))
            out, held = [], 0
    parts.append(pa.array(out, kind))
    return pa.concat_arrays(parts)
