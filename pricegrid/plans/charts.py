"""Queries of what a chart draws: patterns, lines and breaks over the newest columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import cut
from ..operators import overlays as V
from ..operators import structure as S
from .market import KEY, PATTERN, moves, query
from .spine_sql import PIVOTS, sql

NEWEST = 60  # columns on the chart
#: How many of the last pivots a pattern refers to.
SIZE = {"double_bottom": 3, "double_top": 3, "failed_breakout": 4, "failed_breakdown": 4}


def chart(m):
    """The transitions of each key's newest columns."""
    newest = m.groupBy(*KEY).agg(F.max("column_id").alias("newest"))
    return m.join(newest, KEY).filter(F.col("column_id") > F.col("newest") - NEWEST).select(m.columns)


@query(
    sql(
        PIVOTS
        + PATTERN
        + f""",
    ch AS (SELECT symbol, resolution, seq, column_id FROM moves QUALIFY column_id > max(column_id) OVER (PARTITION BY symbol, resolution) - {NEWEST}),
    nth AS (SELECT symbol, resolution, seq, row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq) AS i FROM piv),
    refs AS (
      SELECT p.symbol, p.resolution, p.name, p.seq, r.seq AS ref FROM pat p JOIN nth n ON n.symbol = p.symbol AND n.resolution = p.resolution AND n.seq = p.seq
      JOIN nth r ON r.symbol = n.symbol AND r.resolution = n.resolution AND r.i BETWEEN n.i - CASE WHEN p.name LIKE 'double%' THEN 2 WHEN p.name LIKE 'failed%' THEN 3 ELSE 5 END AND n.i)""",
        """SELECT symbol, resolution, name, seq, array_to_string(list_sort(list(DISTINCT column_id)), ',') AS columns FROM refs LEFT JOIN ch ON ch.symbol = refs.symbol AND ch.resolution = refs.resolution AND ch.seq = refs.ref
        GROUP BY refs.symbol, refs.resolution, name, refs.seq HAVING count(*) = count(column_id)""".replace("SELECT symbol, resolution, name, seq,", "SELECT refs.symbol, refs.resolution, name, refs.seq,"),
    )
)
def pattern_overlays(spark, sf_dir):
    """Patterns all of whose pivots are on the chart; older ones refer to columns that it no longer shows."""
    m = cut(moves(spark, sf_dir))
    pivots = S.pivots(m, KEY)
    last = F.collect_list("seq").over(Window.partitionBy(*KEY).orderBy("seq").rowsBetween(-5, 0))
    size = F.coalesce(F.create_map(*[F.lit(v) for kv in SIZE.items() for v in kv])[F.col("name")], F.lit(6))
    found = S.patterns(pivots, KEY, 2_500).select(*KEY, "seq", "name").join(pivots.select(*KEY, "seq", last.alias("last")), [*KEY, "seq"])
    refs = found.withColumn("refs", F.slice("last", -F.least(size, F.size("last")), F.least(size, F.size("last"))))
    return V.resolved(refs, [*KEY, "name", "seq"], "refs", chart(m), KEY).withColumn("columns", F.array_join(F.transform("columns", lambda c: c.cast("string")), ","))


def _lines(m):
    """The newest row of each line, with the columns of its anchors."""
    of = [*KEY, "kind", "anchor_a_seq", "anchor_b_seq"]
    newest = S.trendlines(m, KEY).groupBy(*of).agg(F.max_by(F.struct("state", "anchor_a_price", "anchor_b_price"), "seq").alias("x"), F.min(F.when(F.col("state") == "broken", F.col("seq"))).alias("break_seq"))
    place = m.select(*KEY, "seq", "column_id")
    a, b, c = (place.select(*KEY, F.col("seq").alias(s), F.col("column_id").alias(n)) for s, n in (("anchor_a_seq", "a_column"), ("anchor_b_seq", "b_column"), ("break_seq", "break_column")))
    line = F.concat_ws(":", "kind", "anchor_a_seq", "anchor_b_seq").alias("line")
    rows = newest.join(a, [*KEY, "anchor_a_seq"]).join(b, [*KEY, "anchor_b_seq"]).join(c, [*KEY, "break_seq"], "left")
    return rows.select(*KEY, line, "a_column", F.col("x.anchor_a_price").alias("a_price"), "b_column", F.col("x.anchor_b_price").alias("b_price"), "x.state", "break_seq", "break_column")


@query()
def trendline_overlays(spark, sf_dir):
    """Every line that a replay of the trendlines leaves, projected to the newest column where it is kept up to date; checked against a plain loop."""
    m = cut(moves(spark, sf_dir))
    return V.line_overlays(_lines(m), chart(m), KEY)


@query()
def break_overlays(spark, sf_dir):
    """Breaks whose transition is still on the chart; checked against a plain loop."""
    m = cut(moves(spark, sf_dir))
    return V.break_overlays(_lines(m).filter("break_seq is not null"), chart(m), KEY)
