"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers (floor(scale * x)). Candidates go to the nearest of a few pivots (rows of the table, by a
hash of their ids) and, within it, to groups of bounded size, so that similar vectors share a group and a pivot with
many rows has many groups. Inside a group they are reordered so that alike ones stand together and cut into ranges,
the blocks. Each group's index is built and written once: the blocks' forward index (the vectors) and, for each term
(dimension), the largest and smallest weight in each block.

A query first meets the group that it would lie in itself; the k-th score there is a floor for the k-th score of all
and goes with it. Queries that share a pivot form batches of bounded size. The interval of all products between a batch's box and
those of a pivot's rows, then of its groups, says which groups can reach the batch's lowest floor, and only these meet it. In a group, blocks are met in the order of their bounds (the sum over the terms
of the larger of weight x maximum and weight x minimum) and scored through the forward index until bounds fall below
the floor or the k-th score. Groups and batches of queries meet in an equi-join on their numbers; what reaches the
floor is merged by a window. Nothing is approximated. On unit vectors without clusters in many dimensions no such
bound can fall below the k-th score, and every block is scored.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; vectors
of unequal length count as padded with zeros; an empty vector scores 0 with everything; ties go to the smaller
id. A query never meets its own row; of several rows with its id and vector, just one is left out, and a query
row that occurs several times is answered as often. With fewer than k candidates, all are returned. An empty
table gives an empty result. Scores are exact while they fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boxes import boxes, deal, dealt, interval_meets
from .common import cut, release, tidy

BLOCK = 64
_AT_ONCE = 8  # blocks scored together
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _range_order(m: np.ndarray) -> np.ndarray:
    """An order of the rows in which each run of BLOCK rows is alike: halve on the widest dimension, again and again."""
    todo, done = [np.arange(len(m))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK or m.shape[1] == 0:
            done.append(rows)
            continue
        x = m[rows].astype(np.float64)
        d = int(x.var(0).argmax())
        rows = rows[np.argsort(x[:, d], kind="stable")]
        half = (len(rows) // 2 + BLOCK - 1) // BLOCK * BLOCK
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


@dataclass
class GroupIndex:
    """Ids (blocks, BLOCK) with how many there are, forward index (blocks, BLOCK, width), term maxima and minima (blocks, width)."""

    n: int
    ids: np.ndarray
    blocks: np.ndarray
    top: np.ndarray
    low: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> GroupIndex:
        order = _range_order(vectors)
        n, count = len(ids), -(-len(ids) // BLOCK)
        edges = np.arange(0, n, BLOCK)
        sorted_ = vectors[order]
        blocks = np.zeros((count * BLOCK, vectors.shape[1]), np.int64)
        blocks[:n] = sorted_
        names = np.zeros(count * BLOCK, np.int64)
        names[:n] = ids[order]
        return GroupIndex(
            n, names.reshape(count, BLOCK), blocks.reshape(count, BLOCK, vectors.shape[1]), np.maximum.reduceat(sorted_, edges, axis=0), np.minimum.reduceat(sorted_, edges, axis=0)
        )

    def pack(self) -> dict[str, object]:
        return {"n": self.n, "width": self.blocks.shape[2], "ids": self.ids.tobytes(), "blocks": self.blocks.tobytes(), "top": self.top.tobytes(), "low": self.low.tobytes()}

    @staticmethod
    def unpack(row: dict) -> GroupIndex:
        count, width = -(-row["n"] // BLOCK), row["width"]
        part = {c: np.frombuffer(row[c] or bytes(), np.int64) for c in ("ids", "blocks", "top", "low")}
        return GroupIndex(row["n"], part["ids"].reshape(count, BLOCK), part["blocks"].reshape(count, BLOCK, width), part["top"].reshape(count, width), part["low"].reshape(count, width))


def search_group(index: GroupIndex, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query row, candidate id, score): the k best of this group that reach the query's floor; and how many blocks were scored."""
    width = max(index.blocks.shape[2], queries.shape[1])
    wide = lambda m: np.pad(m, [(0, 0)] * (m.ndim - 1) + [(0, width - m.shape[-1])])
    blocks, top, low, q = wide(index.blocks), wide(index.top), wide(index.low), wide(queries)
    # float64 multiplies faster, and exactly while sums stay under 2**53
    most = float(np.abs(blocks).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width)
    kind = np.float64 if most < 2**52 else np.int64
    blocks, q = blocks.astype(kind), q.astype(kind)
    bounds = np.maximum(q, 0) @ top.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T
    real = np.arange(index.ids.size).reshape(index.ids.shape) < index.n
    out, scored = [], 0
    for i in range(len(q)):
        names, scores, least = np.zeros(0, np.int64), np.zeros(0, kind), floors[i]
        own = True
        order = np.argsort(-bounds[i], kind="stable")
        for j in range(0, len(order), _AT_ONCE):
            at = order[j : j + _AT_ONCE]
            at = at[bounds[i, at] >= least]
            if not len(at):
                break
            scored += len(at)
            found, who, ok = blocks[at] @ q[i], index.ids[at], real[at].copy()
            if own and len(same := np.argwhere(ok & (who == query_ids[i]) & (found == q[i] @ q[i]))):
                for a, b in same:
                    if own and (blocks[at[a], b] == q[i]).all():
                        ok[a, b], own = False, False
            ok &= found >= least
            names, scores = np.concatenate([names, who[ok]]), np.concatenate([scores, found[ok]])
            pick = np.lexsort((names, -scores))[:k]
            names, scores = names[pick], scores[pick]
            if len(names) == k:
                least = max(least, int(scores[-1]))
        out += [(i, int(name), int(score)) for name, score in zip(names, scores, strict=True)]
    return out, scored


def meetings(rows: DataFrame, floored: DataFrame, pivots: int) -> DataFrame:
    """ub, b, g: the batches of queries (ub, b, v, floor) and the groups of rows (p, g, v) that can have something for them."""
    batch = ["ub", "b"]
    roots = floored.groupBy(*batch).agg(F.min("floor").alias("need")).join(boxes(floored, batch, "box_b"), batch)
    of_pivot, of_group = cut(boxes(rows, ["p"], "box_p")), cut(boxes(rows, ["p", "g"], "box_g"))
    near = roots.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(max(0, pivots - 1))))).join(of_pivot, "p").filter(interval_meets("box_b", "box_p", F.col("need")))
    return cut(near.join(of_group, "p").filter(interval_meets("box_b", "box_g", F.col("need"))).select(*batch, "g"))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_rows: int = 4096,
    batch_rows: int = 2048,
    pivots: int = 64,
) -> DataFrame:
    """``vectors`` -> query_id long, rank int, vec_id long, score long; ``is_query`` marks the rows that ask."""
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    n = rows.count()
    # no more pivots than full groups, so that indexes are few and large
    centres = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, n // group_rows + 1)).select("v").collect()]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1)).astype(np.float64)
            width = max([m.shape[1], *map(len, centres)])
            c = np.array([[*v, *[0] * (width - len(v))] for v in centres], np.float64)
            near = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) @ c.T - (c * c).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "p"])

    placed = cut(rows.mapInArrow(tidy(nearest), "id long, v array<long>, asks boolean, p int").withColumn("row", F.monotonically_increasing_id()))
    counted = placed.groupBy("p").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()  # a row for each pivot
    sizes = {r["p"]: r["n"] for r in counted}

    # each pivot's rows are dealt by a hash over as many groups as they fill
    first, parts, groups = [], [], 0
    for p in range(max(1, len(centres))):
        first.append(F.lit(groups))
        parts.append(F.lit(sizes.get(p, 0) // group_rows + 1))
        groups += sizes.get(p, 0) // group_rows + 1
    at = lambda values: F.get(F.array(*values), F.col("p"))
    group = (at(first) + F.pmod(F.xxhash64("id"), at(parts))).cast("int")
    asking = deal({(0, r["p"]): r["q"] for r in counted}, batch_rows)
    kinds = "n int, width int, ids binary, blocks binary, top binary, low binary"

    def build(part: pa.Table) -> pa.Table:
        packed = GroupIndex.build(part.column("id").to_numpy(), _matrix(part.column("v"))).pack()
        release()
        types = {"n": pa.int32(), "width": pa.int32()}
        return pa.table({"g": pa.array([part.column("g")[0].as_py()], pa.int32()), **{c: pa.array([v], types.get(c, pa.binary())) for c, v in packed.items()}})

    placed = dealt(placed.withColumn("g", group).withColumn("fam", F.lit(0)), asking, pivots, "ub", "b", 2)
    index = cut(placed.select("id", "v", "g").groupBy("g").applyInArrow(build, f"g int, {kinds}"))
    asked = placed.filter("asks").select("row", "id", "v", "g", "ub", "b")

    def meet(left: pa.Table, right: pa.Table) -> tuple[list[tuple[int, int, int]], pa.Table]:
        if not left.num_rows or not right.num_rows:
            return [], right
        floors = right.column("floor").to_numpy() if "floor" in right.column_names else np.full(right.num_rows, _NONE)
        found, _ = search_group(GroupIndex.unpack(left.slice(0, 1).to_pylist()[0]), right.column("id").to_numpy(), _matrix(right.column("v")), floors, k)
        return found, right

    def first_floor(left: pa.Table, right: pa.Table) -> pa.Table:
        found, asked = meet(left, right)
        floors = np.full(asked.num_rows, _NONE)
        count = np.bincount([i for i, _, _ in found], minlength=asked.num_rows) if found else np.zeros(asked.num_rows, np.int64)
        for i, _, score in found:  # a query's hits fall
            floors[i] = score if count[i] == k else _NONE
        return pa.table({"row": asked.column("row"), "id": asked.column("id"), "v": asked.column("v"), "ub": asked.column("ub"), "b": asked.column("b"), "floor": pa.array(floors)})

    floored = cut(index.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(first_floor, "row long, id long, v array<long>, ub int, b int, floor long"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found, asked = meet(left, right)
        at = np.array([h[0] for h in found], np.int64)
        rows, ids = (asked.column(c).to_numpy()[at] if len(at) else np.zeros(0, np.int64) for c in ("row", "id"))
        release()
        return pa.table({"row": rows, "query_id": ids, "vec_id": np.array([h[1] for h in found], np.int64), "score": np.array([h[2] for h in found], np.int64)})

    met = meetings(placed.select("p", "g", "v"), floored, len(centres))
    left, right = index.join(met, "g"), floored.join(met, ["ub", "b"])
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from ``met``
    key = ["ub", "b", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(answer, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
