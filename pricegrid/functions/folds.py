"""Order-dependent folds: what feeds its result back into the next row, and no window can say.

Rows are dealt by key and sorted within their partition; a task walks through them batch by batch and holds
the state of one key at a time, so memory doesn't grow with the history of a key. Time does: a key's rows are
a sequence by nature. Keep everything else out of the fold and feed it only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """The state of one key. ``step`` gets the non-key columns of a row; both give the rows to put out."""

    def step(self, *values) -> Iterable[tuple]: ...

    def finish(self) -> Iterable[tuple]: ...


def plain(column: pa.Array | pa.ChunkedArray) -> list:
    """A column as Python values; whole numbers without nulls go by way of numpy, several times as fast."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def runs(columns: list[pa.Array]) -> Iterator[tuple[tuple, int]]:
    """The values that neighbouring rows share, and how many rows share them."""
    differ = np.zeros(len(columns[0]), dtype=bool)
    differ[0] = True
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        differ[1:] |= code[1:] != code[:-1]
    at = np.flatnonzero(differ).tolist()
    for i, end in zip(at, [*at[1:], len(differ)], strict=True):
        yield tuple(c[i].as_py() for c in columns), end - i


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[..., Fold], schema: str) -> DataFrame:
    """Fold the rows of each key in ``order``; output rows are the key's values and what the fold gives.

    ``df``'s columns are the keys and then the arguments of ``step``; ``start`` gets the key's values.
    Null keys are a key; an empty table gives an empty one.
    """
    values = [c for c in df.columns if c not in keys]
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    width = len(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for b in batches:
            if not b.num_rows:
                continue
            out, of_keys = [], [[] for _ in keys]
            rows = zip(*(plain(b.column(b.schema.get_field_index(v))) for v in values), strict=True)
            for name, n in runs([b.column(b.schema.get_field_index(k)) for k in keys]):
                if fold is None or name != key:
                    if fold is not None:
                        ended = list(fold.finish())
                        out += ended
                        for of, k in zip(of_keys, key, strict=True):
                            of += [k] * len(ended)
                    key, fold = name, start(*name)
                before, step = len(out), fold.step
                for row in islice(rows, n):
                    out += step(*row)
                for of, k in zip(of_keys, key, strict=True):
                    of += [k] * (len(out) - before)
            yield batch(of_keys, out)
        if fold is not None:
            ended = list(fold.finish())
            yield batch([[k] * len(ended) for k in key], ended)

    def batch(of_keys: list[list], rows: list[tuple]) -> pa.RecordBatch:
        columns = [*of_keys, *zip(*rows, strict=True)] if rows else [[]] * width
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
