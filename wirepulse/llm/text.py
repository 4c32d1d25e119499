"""Reading whole texts in Arrow batches: the shared ground of the text operators.

Every operator selects the columns it needs before it adds any, so extra or clashing
columns of the input never meet its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLANKS = b" \t\n\v\f\r"

#: Texts are worked on in groups of about this many bytes, which bounds a task's memory.
GROUP_BYTES = 4 << 20

Rows = Callable[[list, list[bytes]], dict[str, object]]


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    binary = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [b"" if text is None else text for text in binary.to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes; one long text is a range of its own."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, at
            start, held = at, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow twin of a flat Spark DDL string."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of a text column that hold about ``limit`` bytes, without copying the texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def map_texts(
    docs: DataFrame, rows: Rows, ddl: str, make: Callable[[], Rows] | None = None, limit: int | None = None
) -> DataFrame:
    """Apply ``rows(ids, texts) -> columns`` to groups of ``doc_id, text``; nothing is shuffled.

    ``make`` builds the function once per task where it needs a costly state. With ``limit``
    groups hold so many bytes, and only one at a time is copied out of a batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        work = make() if make else rows
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            texts = None if limit else utf8(column)
            for a, b in slices(column, limit) if limit else groups(texts):
                columns = work(ids.slice(a, b - a), utf8(column.slice(a, b - a)) if limit else texts[a:b])
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, kind)
