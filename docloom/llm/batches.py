"""Arrow batches as Python lists: the bridge for rules that built-in expressions cannot state."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_lists(df: DataFrame, rule: Callable[..., list[list]], schema: str, rows: int = 512) -> DataFrame:
    """Apply `rule` to at most `rows` rows at a time: it takes one list per input column and
    returns one list per column of `schema`. Small slices bound the memory of a worker however
    large the Arrow batches of the session are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = rule(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                if out and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


class Both:
    """What is in one of two sets, without a copy of either."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b

    def __contains__(self, x) -> bool:
        return x in self.a or x in self.b


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
