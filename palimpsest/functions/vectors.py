"""Python functions as column functions, where no built-in expression has their semantics.

Values cross in Arrow batches.  A null argument gives null without a call.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "int": pa.int32(),
    "long": pa.int64(),
    "binary": pa.binary(),
    "date": pa.date32(),
    "array<string>": pa.list_(pa.string()),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def _plain(call: Callable, columns: tuple[pa.Array, ...], kind: pa.DataType) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in columns))
    return pa.array([None if None in row else call(*row) for row in rows], kind)


def column_function(call: Callable, returns: str = "string", arrow: pa.DataType | None = None) -> Callable[..., Column]:
    """``call`` on plain values as a function of one to three columns."""
    kind = arrow or _ARROW[returns]

    def one(a: pa.Array) -> pa.Array:
        return _plain(call, (a,), kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return _plain(call, (a, b), kind)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return _plain(call, (a, b, c), kind)

    # made at the call: types are parsed by a session
    return lambda *columns: F.arrow_udf((one, two, three)[len(columns) - 1], returns)(*columns)
