"""Plug-ins: units of others' code that run in partitions, and whose failures are rows like their findings.

A unit is an object with ``find(rows) -> iterable of texts``, given a key's last rows as tuples, the newest last. A unit that
raises leaves a row ``algorithm_failed`` with the error for that place and goes on at the next; the other units never notice.
Units see a window of bounded length, so memory doesn't grow with a key.

Defined results: without units there are no rows; null values reach the units as None; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Unit(Protocol):
    def find(self, rows: list[tuple]) -> Iterable[str]: ...


def run_units(rows: DataFrame, keys: list[str], order: str, values: list[str], units: dict[str, Unit], window: int = 6) -> DataFrame:
    """keys, ``order``, unit, status (found or algorithm_failed), what: one row for each finding and for each failure.

    Each key is a partition of a table function, its rows in ``order``; units get the last ``window`` rows of ``values``.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{order}` {types[order]}", "unit string, status string, what string"])

    @F.udtf(returnType=schema)
    class Units:
        def __init__(self) -> None:
            self.key: tuple | None = None
            self.seen: deque[tuple] = deque(maxlen=window)

        def eval(self, row: Row) -> Iterator[tuple]:
            key = tuple(row[k] for k in keys)
            if key != self.key:  # keys may share a task's instance
                self.key, self.seen = key, deque(maxlen=window)
            self.seen.append(tuple(row[v] for v in values))
            given = list(self.seen)
            for name, unit in units.items():
                try:
                    found = [("found", str(w)) for w in unit.find(list(given))]
                except Exception as e:  # whatever others' code raises
                    found = [("algorithm_failed", f"{type(e).__name__}: {e}")]
                for status, what in found:
                    yield (*key, row[order], name, status, what)

    picked = rows.select(*keys, order, *[v for v in values if v not in keys and v != order])
    return Units(picked.asTable().partitionBy(*keys).orderBy(order))
