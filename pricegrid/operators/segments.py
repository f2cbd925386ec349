"""Columns of a hot symbol: segments folded at the same time from every state they can start in.

A column's edge lies on the grid of its key's first price. After an event at a price, the edge is less than a box behind it or less
than ``reversal`` boxes ahead, so whatever came before, one of 2 * (reversal + 1) states holds, or the first column hasn't begun. Each
segment folds all of them, and those that meet go on as one; what comes out is a map from start to end. Then only one row for each
segment is walked through, to learn which start was the real one, and each segment is folded once more from there.

Defined results: those of ``columns.transitions``; a key has one box. Rows without a price or box change nothing; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.durable import cut
from ..functions.folds import ordered_fold, plain
from .columns import TRANSITION, ColumnFold

State = tuple[int | None, str | None, int, int]  # seed, direction, edge, column
_STATE = "seed long, direction string, edge long, column_id int"


def _fold(state: State, reversal: int) -> ColumnFold:
    fold = ColumnFold(reversal)
    fold.seed, fold.direction, fold.edge, fold.column = state
    return fold


def possible(seed: int, box: int, price: int, reversal: int) -> list[State]:
    """Every state that an event at ``price`` can leave; columns are counted from zero."""
    out: list[State] = [(seed, None, 0, 0)] if abs(price - seed) < box else []
    for direction, behind, ahead in (("X", 1, reversal), ("O", reversal, 1)):
        first = (price - behind * box - seed) // box + 1
        last = -((seed - price - ahead * box) // box) - 1
        out += [(seed, direction, seed + k * box, 0) for k in range(first, last + 1)]
    return out


def segment_map(rows: Iterable[tuple[int, int, int, int]], starts: list[State], reversal: int) -> list[State]:
    """The state that each start leaves after ``rows`` (seq, event_us, price, box), its column counted from the start's."""
    live = [(_fold(s, reversal), [(i, 0)]) for i, s in enumerate(starts)]
    for row in rows:
        moved = False
        for fold, _ in live:
            moved |= bool(fold.step(*row))
        if moved and len(live) > 1:
            met: dict[tuple, tuple[ColumnFold, list[tuple[int, int]]]] = {}
            for fold, members in live:
                one = met.setdefault((fold.direction, fold.edge), (fold, []))
                one[1].extend((i, offset + fold.column - one[0].column) for i, offset in members)
            live = list(met.values())
    out: list[State] = [(None, None, 0, 0)] * len(starts)
    for fold, members in live:
        for i, offset in members:
            out[i] = (fold.seed, fold.direction, fold.edge, fold.column + offset)
    return out


def _valid(part: pa.Table) -> list[tuple[int, int, int, int]]:
    rows = zip(*(part.column(c).to_pylist() for c in ("seq", "event_us", "price", "box")), strict=True)
    return sorted(r for r in rows if r[2] is not None and r[3] and r[3] > 0)


class StartFold:
    """Walks through a key's segments and tells each the state that it starts in."""

    def __init__(self, reversal: int) -> None:
        self.reversal = reversal
        self.state: State = (None, None, 0, 0)

    def step(self, seg: int, first: dict | None, starts: list[dict], ends: list[dict]) -> Iterable[tuple]:
        before = self.state
        if first is not None:
            fold = _fold(before, self.reversal)
            fold.step(0, 0, first["price"], first["box"])
            for s, e in zip(starts, ends, strict=True):
                if (s["direction"], s["edge"]) == (fold.direction, fold.edge):
                    self.state = (fold.seed, e["direction"], e["edge"], fold.column + e["column_id"])
                    break
            else:
                raise ValueError(f"segment {seg} starts in none of its states")
        return ((seg, *before),)

    def finish(self) -> Iterable[tuple]:
        return ()


def transitions(events: DataFrame, keys: list[str], reversal: int = 3, segment: int = 1 << 16) -> DataFrame:
    """``events`` (keys, seq, event_us, price, box) -> keys and the transitions; a task holds ``segment`` values of ``seq`` at most."""
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    of_keys = ", ".join(f"{k} {types[k]}" for k in keys)
    ok = F.col("price").isNotNull() & F.coalesce(F.col("box") > 0, F.lit(False))
    seeds = events.filter(ok).groupBy(*keys).agg(F.min_by("price", "seq").alias("first_price")).select(*[F.col(k).alias(f"__{k}") for k in keys], "first_price")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = events.select(*keys, "seq", "event_us", "price", "box", F.call_function("div", F.col("seq"), F.lit(segment)).alias("seg")).join(seeds, same).drop(*[f"__{k}" for k in keys])
    end = "array<struct<direction:string,edge:long,column_id:int>>"
    map_schema = f"{of_keys}, seg long, first struct<price:long,box:long>, starts array<struct<direction:string,edge:long>>, ends {end}"
    arrow_map = to_arrow_schema(StructType.fromDDL(map_schema))

    def fold_all(part: pa.Table) -> pa.Table:
        valid, key = _valid(part), [part.column(k)[0].as_py() for k in keys]
        first, starts, ends = None, [], []
        if valid:
            seed, (_, _, price, box) = part.column("first_price")[0].as_py(), valid[0]
            first = {"price": price, "box": box}
            found = possible(seed, box, price, reversal)
            made = segment_map(valid[1:], found, reversal)
            starts = [{"direction": d, "edge": e} for _, d, e, _ in found]
            ends = [{"direction": d, "edge": e, "column_id": c} for _, d, e, c in made]
        columns = [*([v] for v in key), [part.column("seg")[0].as_py()], [first], [starts], [ends]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow_map, strict=True)], schema=arrow_map)

    maps = rows.groupBy(*keys, "seg").applyInArrow(fold_all, map_schema)
    begun = cut(ordered_fold(maps.select(*keys, "seg", "first", "starts", "ends"), keys, ["seg"], lambda *_: StartFold(reversal), f"{of_keys}, seg long, {_STATE}"))
    out_schema = f"{of_keys}, {TRANSITION}"
    arrow_out = to_arrow_schema(StructType.fromDDL(out_schema))

    def fold_once(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            key = [left.column(k)[0].as_py() for k in keys]
            s = right.slice(0, 1).to_pylist()[0]
            fold = _fold((s["seed"], s["direction"], s["edge"], s["column_id"]), reversal)
            out = [(*key, *o) for r in _valid(left) for o in fold.step(*r)]
        columns: Iterator = zip(*out, strict=True) if out else iter([[]] * len(arrow_out))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow_out, strict=True)], schema=arrow_out)

    left = rows.drop("first_price")
    return left.groupBy(*keys, "seg").cogroup(begun.groupBy(*keys, "seg")).applyInArrow(fold_once, out_schema)


Chain = list[tuple[int, int]]  # (epoch, what is added to its columns)


def fold_segment(seq: list[int], event_us: list[int], price: list[int], starts: list[State], box: int, reversal: int) -> tuple[list[State], list[Chain], list[tuple]]:
    """Ends and chains of each start, and the transitions of rows 1, 2, ... (row 0 is the event that the starts are left by).

    A transition stands under an epoch, which all starts share that have met by then; a start's chain names its epochs, and what its own
    columns are ahead of theirs. So each transition is put out once, however many starts lead to it.
    """
    chains: list[Chain] = [[(i, 0)] for i in range(len(starts))]
    live = [(_fold(s, reversal), i, [(i, 0)]) for i, s in enumerate(starts)]
    epochs, out, k, n = len(starts), [], 1, len(price)
    while k < n and len(live) > 1:
        low, high = _still_all(live, box)
        while k < n and low < price[k] < high:
            k += 1
        if k == n:
            break
        moved = False
        for fold, epoch, _ in live:
            for row in fold.step(seq[k], event_us[k], price[k], box):
                out.append((epoch, *row))
                moved = True
        if moved:
            met: dict[tuple, list] = {}
            for one in live:
                met.setdefault((one[0].direction, one[0].edge), []).append(one)
            live = []
            for group in met.values():
                fold, epoch, members = group[0]
                if len(group) > 1:
                    members = [(i, offset + f.column - fold.column) for f, _, m in group for i, offset in m]
                    epoch, epochs = epochs, epochs + 1
                    for i, offset in members:
                        chains[i].append((epoch, offset))
                live.append((fold, epoch, members))
        k += 1
    if k < n:
        fold, epoch, _ = live[0]
        low, high = _still(fold, box)
        for p in price[k:]:
            if not low < p < high:
                out += [(epoch, *row) for row in fold.step(seq[k], event_us[k], p, box)]
                low, high = _still(fold, box)
            k += 1
    ends: list[State] = [(None, None, 0, 0)] * len(starts)
    for fold, _, members in live:
        for i, offset in members:
            ends[i] = (fold.seed, fold.direction, fold.edge, fold.column + offset)
    return ends, chains, out


def _still(fold: ColumnFold, box: int) -> tuple[int, int]:
    """Prices strictly between these change nothing."""
    if fold.direction is None:
        return fold.seed - box, fold.seed + box
    ahead, behind = fold.edge + box, fold.edge - fold.reversal * box
    return (behind, ahead) if fold.direction == "X" else (fold.edge - box, fold.edge + fold.reversal * box)


def _still_all(live: list[tuple], box: int) -> tuple[int, int]:
    """Prices strictly between these change none of the folds."""
    lows, highs = zip(*(_still(fold, box) for fold, _, _ in live), strict=True)
    return max(lows), min(highs)


class ChainFold(StartFold):
    """Tells each segment the chain of the start that is the real one, with the columns so far, and the transition of its first event."""

    def step(self, seg: int, first: dict, starts: list[dict], ends: list[dict], chains: list[list[dict]]) -> Iterable[tuple]:
        fold = _fold(self.state, self.reversal)
        told = list(fold.step(first["seq"], first["event_us"], first["price"], first["box"]))
        for s, e, chain in zip(starts, ends, chains, strict=True):
            if (s["direction"], s["edge"]) == (fold.direction, fold.edge):
                self.state = (fold.seed, e["direction"], e["edge"], fold.column + e["column_id"])
                names = ("seq", "event_us", "kind", "column_id", "direction", "from_price", "to_price", "boxes", "box")
                return ((seg, [{"epoch": c["epoch"], "base": fold.column + c["ahead"]} for c in chain], dict(zip(names, told[0], strict=True)) if told else None),)
        raise ValueError(f"segment {seg} starts in none of its states")


def moves(events: DataFrame, resolutions: dict[str, int], reversal: int = 3, segment: int = 1 << 15) -> DataFrame:
    """``columns.transitions`` of ``fan_out``: events (symbol, seq, event_us, price) -> symbol, resolution and the transitions.

    Events are shuffled once for all resolutions, by symbol and segment, and folded once: a task holds ``segment`` values of ``seq`` of a
    symbol at most, and prices between a column's thresholds are passed over. What each segment says about its starts is one row, and the
    transitions of the real start are picked by a join.
    """
    symbol = dict(events.dtypes)["symbol"]
    seg = F.call_function("div", F.col("seq"), F.lit(segment)).alias("seg")
    rows = events.select("symbol", "seq", "event_us", "price", seg)
    began = rows.filter("price is not null").groupBy("symbol", "seg").agg(F.min_by("price", "seq").alias("p"))
    seeds = began.select(F.col("symbol").alias("__symbol"), F.col("seg").alias("__seg"), F.first("p").over(Window.partitionBy("symbol").orderBy("seg")).alias("seed"))
    chain = "array<struct<epoch:int,ahead:long>>"
    map_ddl = f"first struct<seq:long,event_us:long,price:long,box:long>, starts array<struct<direction:string,edge:long>>, ends array<struct<direction:string,edge:long,column_id:long>>, chains array<{chain}>"
    schema = f"symbol {symbol}, resolution string, seg long, {map_ddl}, epoch int, {TRANSITION}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    told = len(StructType.fromDDL(map_ddl))

    def table(key: list, first: int, columns: list) -> pa.Table:
        """Rows whose columns from ``first`` on are ``columns``; those before are the same in each row, the others null."""
        n = len(columns[0])
        arrays = [pa.repeat(pa.scalar(v, f.type), n) for v, f in zip(key, arrow, strict=False)]
        arrays += [pa.nulls(n, arrow.field(i).type) for i in range(len(key), first)]
        arrays += [pa.array(c, arrow.field(first + i).type) for i, c in enumerate(columns)]
        return pa.table(arrays + [pa.nulls(n, arrow.field(i).type) for i in range(len(arrays), len(arrow))], schema=arrow)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = [arrow.empty_table()]
        if left.num_rows and right.num_rows:
            at = left.filter(left.column("price").is_valid()).sort_by("seq")
            seq, us, price = (plain(at.column(c)) for c in ("seq", "event_us", "price"))
            seed, of = right.column("seed")[0].as_py(), left.column("seg")[0].as_py()
            for name, box in resolutions.items():
                key = [left.column("symbol")[0].as_py(), name, of]
                starts = possible(seed, box, price[0], reversal)
                ends, chains, made = fold_segment(seq, us, price, starts, box, reversal)
                out.append(table(key, 3, [
                    [{"seq": seq[0], "event_us": us[0], "price": price[0], "box": box}], [[{"direction": d, "edge": e} for _, d, e, _ in starts]],
                    [[{"direction": d, "edge": e, "column_id": c} for _, d, e, c in ends]], [[[{"epoch": i, "ahead": o} for i, o in c] for c in chains]],
                ]))
                if made:
                    out.append(table(key, 3 + told, list(zip(*made, strict=True))))
        return pa.concat_tables(out).combine_chunks()

    folded = cut(rows.groupBy("symbol", "seg").cogroup(seeds.groupBy("__symbol", "__seg")).applyInArrow(fold, schema))
    key = ["symbol", "resolution"]
    maps = folded.filter("first is not null").select(*key, "seg", "first", "starts", "ends", "chains")
    begun_ddl = f"symbol {symbol}, resolution string, seg long, chain array<struct<epoch:int,base:long>>, first struct<{', '.join(f.replace(' ', ':', 1) for f in TRANSITION.split(', '))}>"
    begun = cut(ordered_fold(maps, key, ["seg"], lambda *_: ChainFold(reversal), begun_ddl))
    real = begun.select(*[F.col(c).alias(f"__{c}") for c in (*key, "seg")], F.explode("chain").alias("c")).select("*", "c.epoch", "c.base").drop("c").withColumnRenamed("epoch", "__epoch")
    same = F.lit(True)
    for c in (*key, "seg", "epoch"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    names = [f.split(" ")[0] for f in TRANSITION.split(", ")]
    picked = folded.filter("epoch is not null").join(real, same).withColumn("column_id", (F.col("column_id") + F.col("base")).cast("int")).select(*key, *names)
    return picked.unionByName(begun.filter("first is not null").select(*key, "first.*"))
