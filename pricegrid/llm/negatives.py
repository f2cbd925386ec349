"""Hard-negative mining by dual-tree search.

Vectors become whole numbers (floor(scale * x)). Rows lie in cells by label family and nearest pivot. Large cells are
dealt by a hash into groups of bounded size, small ones put together, and each group is a tree, built and written once:
split by label while it has few, then halved on its widest dimension down to leaves of 64 rows, every node with the
smallest and largest value of each dimension, and its label if it has only one. Anchors form batches of bounded size in the
same way, trees whose nodes also carry the scores that their anchors still ask for.
Two nodes give an interval that holds every inner product of their rows. Where it lies below all floors or above all
ceilings of the anchor node, or where the labels rule the pair out, the whole group of anchors is done with the whole
candidate node; otherwise the larger node is opened, and pairs of leaves are scored exactly. The trees go on above the
groups: a batch's root meets the boxes of units of groups (as many as cells at most), then those of the groups in the
units that remain, and only a batch and a group that still have something to tell each other receive each other's rows.

Both passes are such a search. Positives: an anchor's best rows of its own label. Negatives: for each of its positives
a target, the best rows of another label within a window of scores that the positive's score sets. In either, an anchor
first meets a group (of its own cell; of the next unit), whose k-th score is a floor for all others.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; an anchor's own row
is no candidate, but another row of the same id and vector is one; repeated anchors are answered each; vectors
of unequal length count as padded with zeros; ties go to the smaller id. Without positives or without negatives in the window an
anchor has no rows. An empty table gives an empty result; only the three named columns are read. Scores are exact
while they fit 64-bit integers.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boxes import boxes, deal, dealt, interval_meets
from .common import cut, release, tidy
from .vectors import _matrix

_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TREE = ("order", "span", "child", "low", "high", "mixed", "label")


@dataclass
class Tree:
    """Rows in tree order, and nodes as (first row, last row + 1, left child; the right one follows it), -1 for a leaf.

    ``pure`` has a node's label where it has just one; ``low`` and ``high`` its box.
    """

    order: np.ndarray
    span: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mixed: np.ndarray
    label: np.ndarray

    @staticmethod
    def build(m: np.ndarray, labels: np.ndarray, leaf: int = 64) -> Tree:
        order, span, child = np.arange(len(m)), [(0, len(m))], [-1]
        k = 0
        while k < len(span):
            a, b = span[k]
            if b - a > leaf and m.shape[1]:
                rows = order[a:b]
                kinds, count = np.unique(labels[rows], return_counts=True)
                if 1 < len(kinds) <= 16:  # at the edge between two labels that is nearest to the middle
                    order[a:b] = rows[np.argsort(labels[rows], kind="stable")]
                    edge = np.cumsum(count)[:-1]
                    half = a + int(edge[np.abs(edge - (b - a) // 2).argmin()])
                else:
                    x = m[rows]
                    d = int((x.max(0) - x.min(0)).argmax())
                    order[a:b] = rows[np.argsort(x[:, d], kind="stable")]
                    half = a + ((b - a) // 2 + leaf - 1) // leaf * leaf
                child[k] = len(span)
                span += [(a, half), (half, b)]
                child += [-1, -1]
            k += 1
        width = m.shape[1]
        low, high = np.zeros((len(span), width), m.dtype), np.zeros((len(span), width), m.dtype)
        first, last = np.zeros(len(span), np.int64), np.zeros(len(span), np.int64)
        for k in range(len(span) - 1, -1, -1):  # children come after their parent
            c = child[k]
            if c < 0:
                rows = order[slice(*span[k])]
                if len(rows):
                    low[k], high[k] = m[rows].min(0), m[rows].max(0)
                    first[k], last[k] = labels[rows].min(), labels[rows].max()
            else:
                low[k], high[k] = np.minimum(low[c], low[c + 1]), np.maximum(high[c], high[c + 1])
                first[k], last[k] = min(first[c], first[c + 1]), max(last[c], last[c + 1])
        return Tree(order, np.array(span, np.int64), np.array(child, np.int64), low, high, first != last, first)


def interval(low_a: np.ndarray, high_a: np.ndarray, low_c: np.ndarray, high_c: np.ndarray) -> tuple[float, float]:
    """Bounds of x . y for x in one box and y in the other: in each dimension the extremes lie at corners."""
    corners = np.stack([low_a * low_c, low_a * high_c, high_a * low_c, high_a * high_c])
    return corners.min(0).sum(), corners.max(0).sum()


@dataclass
class Side:
    """Rows of one side of a meeting: ids, unique row numbers, labels, vectors, and their tree."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: Tree

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int) -> Side:
        return Side(ids, rows, labels, vectors, Tree.build(vectors, labels, leaf))

    def pack(self) -> bytes:
        """The vectors in the smallest whole numbers that hold them."""
        small = np.min_scalar_type(-int(np.abs(self.vectors).max(initial=1)) - 1)
        out = io.BytesIO()
        part = {"ids": self.ids, "rows": self.rows, "labels": self.labels, "vectors": self.vectors.astype(small)}
        np.savez(out, **part, **{f"tree_{f}": getattr(self.tree, f) for f in _TREE})
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Side:
        part = np.load(io.BytesIO(data))
        return Side(part["ids"], part["rows"], part["labels"], part["vectors"].astype(np.int64), Tree(*[part[f"tree_{f}"] for f in _TREE]))


def search(anchors: Side, candidates: Side, of: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, scores, how many) of the best ``k`` candidates of each target, and the number of leaf pairs scored.

    Target t belongs to anchor ``of[t]`` and takes scores from ``floor[t]`` to ``ceiling[t]`` of rows with the anchor's label
    or of the other ones.
    """
    targets, width = len(of), max(anchors.vectors.shape[1], candidates.vectors.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    a, c = wide(anchors.vectors), wide(candidates.vectors)
    # float64 multiplies faster, and exactly while sums stay under 2**53
    most = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
    kind = np.float64 if most < 2**52 else np.int64
    a, c = a.astype(kind), c.astype(kind)
    left, right = anchors.tree, candidates.tree
    low_a, high_a, low_c, high_c = (wide(m).astype(kind) for m in (left.low, left.high, right.low, right.high))
    place = np.empty(len(a), np.int64)
    place[left.order] = np.arange(len(a))
    by_place = np.argsort(place[of], kind="stable")  # targets in the order of the anchors' tree
    edges = np.searchsorted(place[of][by_place], np.arange(len(a) + 1))
    of, least, limit = of[by_place], floor[by_place].copy(), ceiling[by_place]
    best, names, count = np.full((targets, k), _MIN), np.full((targets, k), _MAX), np.zeros(targets, np.int64)
    asks = lambda n: slice(edges[left.span[n, 0]], edges[left.span[n, 1]])

    def bounds(x: int, y: int) -> tuple[float, float]:
        if most >= 2**62:  # corners might not fit; the scores themselves may
            return -np.inf, np.inf
        return interval(low_a[x], high_a[x], low_c[y], high_c[y])

    def out_of_reach(x: int, y: int, low: float, high: float) -> bool:
        t = asks(x)
        if t.start == t.stop or high < least[t].min() or low > limit[t].max():
            return True
        if left.mixed[x] or right.mixed[y]:
            return False
        return (left.label[x] == right.label[y]) != same_label

    def score(x: int, y: int) -> None:
        t, some = asks(x), right.order[slice(*right.span[y])]
        found = (a[of[t]] @ c[some].T).astype(np.int64)
        ok = (found >= least[t, None]) & (found <= limit[t, None])
        ok &= (anchors.labels[of[t], None] == candidates.labels[some]) == same_label
        ok &= anchors.rows[of[t], None] != candidates.rows[some]
        hit = np.flatnonzero(ok.any(1))
        if not len(hit):
            return
        at = hit + t.start
        both = np.concatenate([best[at], found[hit]], 1)
        whose = np.concatenate([names[at], np.broadcast_to(candidates.ids[some], (len(hit), len(some)))], 1)
        real = np.concatenate([np.arange(k) < count[at, None], ok[hit]], 1)
        pick = np.lexsort((whose, ~both, ~real), axis=1)[:, :k]  # ~ turns the order of whole numbers round
        best[at], names[at] = np.take_along_axis(both, pick, 1), np.take_along_axis(whose, pick, 1)
        count[at] = np.minimum(k, count[at] + ok[hit].sum(1))
        full = at[count[at] == k]
        least[full] = np.maximum(least[full], best[full, k - 1])

    heap, scored = [], 0
    if targets and len(c):
        heap.append((0.0, 0, 0, *bounds(0, 0)))
    while heap:  # the pair with the highest bound first
        _, x, y, low, high = heapq.heappop(heap)
        if out_of_reach(x, y, low, high):
            continue
        if left.child[x] < 0 and right.child[y] < 0:
            scored += 1
            score(x, y)
            continue
        n_left, n_right = left.span[x, 1] - left.span[x, 0], right.span[y, 1] - right.span[y, 0]
        if right.child[y] >= 0 and (left.child[x] < 0 or n_right >= n_left):
            opened = [(x, right.child[y]), (x, right.child[y] + 1)]
        else:
            opened = [(left.child[x], y), (left.child[x] + 1, y)]
        for p, q in opened:
            low, high = bounds(p, q)
            if not out_of_reach(p, q, low, high):
                heapq.heappush(heap, (-float(high), int(p), int(q), low, high))
    back = np.empty(targets, np.int64)
    back[by_place] = np.arange(targets)
    return names[back], best[back], count[back], scored


def _boxes(rows: DataFrame, by: list[str], box: str) -> DataFrame:
    """``by``, the box, its label families (a bit each), smallest and largest label."""
    told = rows.groupBy(*by).agg(F.bit_or(F.expr("shiftleft(1, fam)")).alias(f"families_{box}"), F.min("y").alias(f"low_{box}"), F.max("y").alias(f"high_{box}"))
    return told.join(boxes(rows, by, box), by)


def _may_meet(a: str, b: str, same_label: bool) -> Column:
    """Whether the boxes ``a`` (which has need and cap) and ``b`` leave a pair of rows that counts."""
    if same_label:
        labels = (F.col(f"families_{a}").bitwiseAND(F.col(f"families_{b}")) != 0) & (F.col(f"low_{a}") <= F.col(f"high_{b}")) & (F.col(f"high_{a}") >= F.col(f"low_{b}"))
    else:
        labels = ~((F.col(f"low_{a}") == F.col(f"high_{a}")) & (F.col(f"low_{b}") == F.col(f"high_{b}")) & (F.col(f"low_{a}") == F.col(f"low_{b}")))
    return labels & interval_meets(a, b, F.col("need"), F.col("cap"))


class _Search:
    """The groups, written once, and the passes over them."""

    batch, group = ["ub", "b"], ["u", "g"]

    def __init__(self, placed: DataFrame, units: int) -> None:
        self.units = units
        rows = placed.select(*self.group, "fam", "id", "row", "y", "v")
        self.boxes = cut(_boxes(rows, self.group, "box_g"))
        self.unit_boxes = cut(_boxes(rows, ["u"], "box_u"))

        def build(part: pa.Table) -> pa.Table:
            packed = _side(part, 64).pack()
            release()
            return pa.table({"u": part.column("u").slice(0, 1), "g": part.column("g").slice(0, 1), "data": pa.array([packed], pa.binary())})

        self.index = cut(rows.drop("fam").groupBy(*self.group).applyInArrow(build, "u int, g int, data binary"))

    def meetings(self, asked: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
        """row, id, t, found, score of the batches and groups in ``pairs``; a task holds one batch and one group, both of bounded size."""
        types = {"row": pa.int64(), "id": pa.int64(), "t": pa.int64(), "found": pa.int64(), "score": pa.int64()}

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], t) for c, t in types.items()})
            anchors, targets = _side(left, 32), left.column("targets").combine_chunks()
            of = np.repeat(np.arange(left.num_rows), targets.value_lengths().to_numpy(zero_copy_only=False))
            flat = targets.flatten()
            t, floor, ceiling = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "floor", "ceiling"))
            who, score, count, _ = search(anchors, Side.unpack(right.column("data")[0].as_py()), of, floor, ceiling, k, same_label)
            hit = np.repeat(np.arange(len(of)), count)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            out = {"row": anchors.rows[of[hit]], "id": anchors.ids[of[hit]], "t": t[hit], "found": who[hit, nth], "score": score[hit, nth]}
            release()
            return pa.table({c: pa.array(out[c], types[c]) for c in types})

        key = [*self.batch, *self.group]
        left, right = asked.join(pairs, self.batch), self.index.join(pairs, self.group)
        left = left.toDF(*left.columns)  # columns of its own, as both sides come from ``pairs``
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "row long, id long, t long, found long, score long")

    def best(self, asked: DataFrame, first: DataFrame, k: int, same_label: bool) -> DataFrame:
        """row, id, t, found, score, nth: the best ``k`` of each target. ``first`` says which groups a batch meets before all others."""
        order = F.row_number().over(Window.partitionBy("row", "t").orderBy(F.desc("score"), "found"))
        before = cut(self.meetings(asked, first, k, same_label).withColumn("nth", order).filter(F.col("nth") <= k))
        # an anchor has a few targets
        reached = before.filter(F.col("nth") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("t", "score"))).alias("reached"))
        raised = F.transform("targets", lambda x: F.struct(x["t"].alias("t"), F.greatest(x["floor"], F.col("reached")[x["t"]]).alias("floor"), x["ceiling"].alias("ceiling")))
        floored = cut(asked.join(reached, "row", "left").withColumn("targets", F.when(F.col("reached").isNull(), F.col("targets")).otherwise(raised)).drop("reached"))
        need = floored.groupBy(*self.batch).agg(F.min(F.array_min(F.transform("targets", lambda x: x["floor"]))).alias("need"), F.max(F.array_max(F.transform("targets", lambda x: x["ceiling"]))).alias("cap"))
        roots = need.join(_boxes(floored, self.batch, "box_b"), self.batch)
        met = roots.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(max(0, self.units - 1))))).join(self.unit_boxes, "u").filter(_may_meet("box_b", "box_u", same_label))
        near = met.join(self.boxes, "u").filter(_may_meet("box_b", "box_g", same_label)).select(*self.batch, *self.group)
        rest = cut(near.join(first, [*self.batch, *self.group], "left_anti"))
        every = before.drop("nth").unionByName(self.meetings(floored, rest, k, same_label))
        return every.withColumn("nth", order).filter(F.col("nth") <= k)


def _side(part: pa.Table, leaf: int) -> Side:
    column = lambda c: part.column(c).to_numpy().astype(np.int64)
    return Side.build(column("id"), column("row"), column("y"), _matrix(part.column("v")), leaf)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_rows: int = 4096,
    batch_rows: int = 512,
    pivots: int = 16,
    families: int = 16,
) -> DataFrame:
    """``vectors`` -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` marks the anchors, ``label`` gives a whole number; window[0] * positive <= window[2] * negative <= window[1] * positive.
    """
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("y"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    n = rows.count()
    # at most ``pivots`` rows, which every task gets
    centres = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, n // (group_rows * families) + 1)).select("v").collect()]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(2)).astype(np.float64)
            width = max([m.shape[1], *map(len, centres)])
            c = np.array([[*v, *[0] * (width - len(v))] for v in centres], np.float64)
            near = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) @ c.T - (c * c).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "p"])

    named = rows.mapInArrow(tidy(nearest), "id long, y long, v array<long>, asks boolean, p int")
    placed = cut(named.withColumn("row", F.monotonically_increasing_id()).withColumn("fam", F.pmod("y", F.lit(families)).cast("int")))
    # a row for each cell, families * pivots at most
    sizes = {(r["fam"], r["p"]): (r["n"], r["q"]) for r in placed.groupBy("fam", "p").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    cells = deal({c: many for c, (many, _) in sizes.items()}, group_rows)
    asking = deal({c: asked for c, (_, asked) in sizes.items()}, batch_rows)
    placed = dealt(placed, cells, pivots, "u", "g", 1)
    run = _Search(placed, max((u for u, _ in cells.values()), default=-1) + 1)
    anchors = dealt(placed.filter("asks"), asking, pivots, "ub", "b", 2).select("ub", "b", "u", "fam", "id", "row", "y", "v")

    target = F.struct(F.lit(0).cast("long").alias("t"), F.lit(_MIN).alias("floor"), F.lit(_MAX).alias("ceiling"))
    own = anchors.select(*run.batch, "u", F.lit(0).alias("g")).distinct()
    found = run.best(anchors.drop("u").withColumn("targets", F.array(target)), own, positives, True)
    found = cut(found.select("row", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("nth").cast("long").alias("t")))

    low, high, whole = window
    # the least and the largest whole score in a positive's window; pmod makes the divisions exact
    down = f"(({{0}}) - pmod({{0}}, {whole})) div {whole}"
    edges = found.select("row", "t", F.expr("-(" + down.format(f"(-positive_score * {low})") + ")").alias("floor"), F.expr(down.format(f"(positive_score * {high})")).alias("ceiling"))
    targets = edges.filter("floor <= ceiling").groupBy("row").agg(F.collect_list(F.struct("t", "floor", "ceiling")).alias("targets"))  # ``positives`` at most
    wanted = cut(anchors.join(targets, "row"))
    following = wanted.select(*run.batch, F.pmod(F.col("u") + 1, F.lit(max(1, run.units))).alias("u"), F.lit(0).alias("g")).distinct()
    mined = run.best(wanted.drop("u"), following, negatives, False)
    return mined.join(found, ["row", "t"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("nth").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
