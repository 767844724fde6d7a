"""Running row kernels over Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of text that a kernel sees at once; one longer text comes alone.
CHUNK_CHARS = 1 << 20

#: How to give up what the kernels of a module remember from task to task in one Python worker.
_MEMORIES: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Declare that kernels of ``module`` keep tables between tasks; they go when a kernel of another module starts."""
    _MEMORIES[module] = forget


def _enter(module: str) -> None:
    """Workers serve all stages of a job, so one that starts another kernel must not hold the tables of the last."""
    for other, forget in _MEMORIES.items():
        if other != module:
            forget()


def leave() -> None:
    """Hand freed memory back, which Arrow and the C library would keep for a next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[dict[str, list]]:
    """Columns as lists, cut so that the texts (or lists) of a chunk have about ``limit`` bytes (or entries)."""
    for batch in batches:
        names = batch.schema.names
        column = batch.column(text)
        measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
        lengths = pc.fill_null(measure(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield dict(zip(names, (c.to_pylist() for c in batch.slice(start, i - start).columns)))
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield dict(zip(names, (c.to_pylist() for c in batch.slice(start).columns)))


def map_chunks(df: DataFrame, text: str, schema: str,
               kernel: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` for a kernel that turns chunks of columns into columns of ``schema``."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    module = kernel.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(module)
        for out in kernel(chunks(batches, text)):
            yield pa.RecordBatch.from_arrays([
                c if isinstance(c := out[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow], schema=arrow)
        leave()

    return df.mapInArrow(run, schema)


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")) % modulus
