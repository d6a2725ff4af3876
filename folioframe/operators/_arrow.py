"""Row functions over Arrow batches: ids stay integers beside nulls, and output batches stay small."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS, IN_ROWS = 4096, 256


class Made(NamedTuple):
    """Rows whose bytes are made of ``columns`` only where they are read: after joins and in the reader's own pass, so they go through no shuffle and no second worker."""

    rows: DataFrame
    columns: tuple[str, ...]
    make: Callable[..., bytes | None]


def made(df: DataFrame | Made, column: str = "contents") -> Made:
    """What is made later, or a frame's ``column`` as it is."""
    return df if isinstance(df, Made) else Made(df, (column,), lambda held: held)


def values(column: pa.Array) -> list:
    """What ``to_pylist`` gives, with structs and lists taken apart by columns, not by scalars."""
    kind = column.type
    if pa.types.is_list(kind):
        inner, at, out = values(column.flatten()), 0, []
        for n in pc.list_value_length(column).to_pylist():
            out.append(None if n is None else inner[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [kind.field(i).name for i in range(kind.num_fields)]
        rows = [dict(zip(names, row)) for row in zip(*map(values, column.flatten()))]
        return [row if held else None for row, held in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows
    return column.to_pylist()


def map_rows(df: DataFrame, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``each`` gets a row's values and returns result rows, all in Python.

    A batch is taken apart ``IN_ROWS`` at a time, and what they gave goes on before the next,
    so a worker holds no more Python values of a large table than of a small one.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IN_ROWS):
                out: list[tuple] = []
                for row in zip(*map(values, batch.slice(at, IN_ROWS).columns)):
                    out.extend(each(*row))
                    if len(out) >= OUT_ROWS:
                        yield packed(out)
                        out = []
                if out:
                    yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return df.mapInArrow(run, schema)
