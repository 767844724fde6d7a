"""Python kernels over whole groups, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes that a kernel sees at once, and one group more at most.
ROWS, BYTES = 50_000, 16 << 20


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which the keys change, the first included; nulls are equal."""
    fresh = np.zeros(len(table), bool)
    fresh[:1] = True
    for key in keys:
        codes = pc.dictionary_encode(table[key].combine_chunks(), null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by group, with the bounds of their groups."""
    load = lambda part: max(part.num_rows / rows, part.nbytes / BYTES)
    held, full, wanted = [], 0.0, 1.0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        full += load(batch)
        if full >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            bounds = begins(table, keys)
            if len(bounds) > 1:  # the last group may go on
                yield table.slice(0, bounds[-1]), bounds
                table = table.slice(bounds[-1])
            held, full = table.to_batches(), load(table)
            wanted = max(1.0, 2 * full)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(begins(table, keys), len(table))


def map_groups(df: DataFrame, keys: list[str], schema: str, kernel: Callable[[pa.Table, np.ndarray], pa.Table],
               order: list[Column | str] = ()) -> DataFrame:
    """Rows of ``schema`` that ``kernel`` makes of tables of whole groups, sorted by group and ``order``.

    The kernel gets the table and the bounds of its groups. Grouped pandas takes milliseconds for each group, however small; here
    they share a table. A group is held whole, so callers bound it.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            yield from kernel(table, bounds).select(arrow.names).cast(arrow).combine_chunks().to_batches(max_chunksize=ROWS)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_frames(df: DataFrame, keys: list[str], schema: str, kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``kernel`` over the rows of each group as a frame, for groups that a caller bounds; many share one table on the way in and out."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        frame = table.to_pandas()
        out = [kernel(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds[:-1], bounds[1:])]
        out = [part[arrow.names] for part in out if len(part)]
        columns = {f.name: pa.array(np.concatenate([part[f.name].to_numpy() for part in out]), f.type, from_pandas=True) for f in arrow} if out else {}
        return pa.table(columns, schema=arrow) if out else arrow.empty_table()

    return map_groups(df, keys, schema, run)
