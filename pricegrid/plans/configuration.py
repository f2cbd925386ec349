"""Queries of names, configuration documents, plug-ins, sessions and totals over groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding as D
from ..operators import plugins as P
from ..operators import similarity as N
from ..operators import structure as S
from ..sources.events import price_events, table
from .market import KEY, moves, query
from .spine_sql import EVENTS, PIVOTS, sql
from .validation import ORACLE_SQL, QUERIES


@query()
def similar_part_names(spark, sf_dir):
    """Pairs of names whose matching blocks hold four fifths of their letters."""
    return N.similar_names(table(spark, sf_dir, "part"), "p_name", 0.8)


@query()
def symbol_discovery(spark, sf_dir, hint: str = "spring part"):
    """Every part as a candidate for a hint: exact ones first, then by the ratio of matching letters."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_brand") == "Brand#1").alias("exact"))
    names = N.with_ratio(p.select("p_name").distinct().select(F.lit(hint).alias("hint"), "p_name"), "hint", "p_name").select(F.col("p_name").alias("name"), "ratio")
    return p.join(names, F.col("p_name") == F.col("name")).select("p_partkey", "exact", "ratio")


# a configuration for each order; its key decides which mistake it has, if any

CONFIG = {
    "name": "text", "box": "number", "reversal": "whole", "enabled": "flag", "mode": ("fixed", "atr"), "from?": "time", "levels?": "list:number",
    "sizing": {"least": "number", "most": "number", "note?": "text"},
}
_GOOD = '{"name": "o@", "box": "0.5", "reversal": 3, "enabled": true, "mode": "fixed", "from": "2024-01-01T00:00:00Z", "levels": [1, "2.5"], "sizing": {"least": 1, "most": 2.5}}'
#: (what is replaced, by what, the refusals)
MISTAKES = (
    ("", "", ""), ('"box": "0.5"', '"box": NaN', "$:undecodable_json"), ('"box": "0.5"', '"box": 1, "box": 2', "$:undecodable_json"), ('"box": "0.5"', '"box": "NaN"', "$.box:non_finite_decimal"),
    ('"box": "0.5"', '"box": true', "$.box:invalid_scalar"), ('"reversal": 3', '"reversal": "3"', "$.reversal:invalid_scalar"), ('"enabled": true', '"enabled": 1', "$.enabled:invalid_scalar"),
    ('"mode": "fixed"', '"mode": "other"', "$.mode:invalid_literal"), ("00:00Z", "00:00", "$.from:timezone_required"), ('"levels": [1, "2.5"]', '"levels": [1, "x", false]', "$.levels[1]:non_finite_decimal,$.levels[2]:invalid_scalar"),
    ('"levels": [1, "2.5"]', '"levels": 7', "$.levels:invalid_tuple"), ('"least": 1', '"extra": 1', "$.sizing.least:missing_field,$.sizing:unknown_schema_fields:extra"), ('"name"', '"title"', "$.name:missing_field,$:unknown_schema_fields:title"),
    ('"sizing": {"least": 1, "most": 2.5}', '"sizing": 5', "$.sizing.least:missing_field,$.sizing.most:missing_field,$.sizing:invalid_object"), (', "from": "2024-01-01T00:00:00Z"', "", ""), ("}}", "}", "$:undecodable_json"),
)
MISTAKES = tuple((a, b, "$.sizing:invalid_object" if "invalid_object" in c else c) for a, b, c in MISTAKES)


@query(
    "SELECT o_orderkey, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, c) in enumerate(MISTAKES)) + " END AS refused, o_orderkey % 16 IN ("
    + ", ".join(str(i) for i, m in enumerate(MISTAKES) if not m[2]) + ") AS taken FROM orders"
)
def config_refusals(spark, sf_dir):
    """Why each document is refused, with the path; the good ones are taken."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*[F.lit(_GOOD.replace(a, b) if a else _GOOD) for a, b, _ in MISTAKES]), (k % 16 + 1).cast("int"))
    found = D.refusals(F.replace(text, F.lit("@"), k.cast("string")), CONFIG)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("refused"), (F.size(found) == 0).alias("taken"))


@query(
    """SELECT o_orderkey, CASE WHEN c AND i AND NOT s THEN CASE WHEN t THEN 'time_offset_conflict' ELSE 'binding' END WHEN (c AND s) OR (NOT c AND i) THEN 'feed_mode_conflict' WHEN c THEN 'not_configured' WHEN s THEN 'legacy' ELSE 'not_configured' END AS mode
    FROM (SELECT o_orderkey, o_orderkey % 2 = 1 AS c, o_orderkey // 2 % 2 = 1 AS i, o_orderkey // 4 % 2 = 1 AS s, o_orderkey // 8 % 2 = 1 AS t FROM orders)"""
)
def feed_modes(spark, sf_dir):
    """All sixteen ways in which the four settings can be there."""
    there = [F.col("o_orderkey").bitwiseAND(F.lit(1 << b)) > 0 for b in range(4)]
    return table(spark, sf_dir, "orders").select("o_orderkey", D.feed_mode(*there).alias("mode"))


class Swing:
    """The newest pivot beyond the one of the same kind before it."""

    def find(self, rows):
        same = [price for kind, price in rows if kind == rows[-1][0]]
        if len(same) > 1 and same[-1] != same[-2]:
            yield "higher" if same[-1] > same[-2] else "lower"


class Fragile:
    """Fails where the newest pivot is a low that lies below the whole window."""

    def find(self, rows):
        kind, price = rows[-1]
        if kind == "low" and price < min([p for _, p in rows[:-1]], default=price):
            raise ArithmeticError("new low")
        yield kind


@query(
    sql(
        PIVOTS
        + """,
    x AS (SELECT *, lag(price, 2) OVER w AS same, min(price) OVER (PARTITION BY symbol, resolution ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS least,
            lag(kind, 1) OVER w AS k1, lag(kind, 2) OVER w AS k2, lag(kind, 3) OVER w AS k3, lag(kind, 4) OVER w AS k4, lag(kind, 5) OVER w AS k5,
            lag(price, 1) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(price, 3) OVER w AS p3, lag(price, 4) OVER w AS p4, lag(price, 5) OVER w AS p5
          FROM piv WINDOW w AS (PARTITION BY symbol, resolution ORDER BY seq)),
    y AS (SELECT *, CASE kind WHEN k1 THEN p1 WHEN k2 THEN p2 WHEN k3 THEN p3 WHEN k4 THEN p4 WHEN k5 THEN p5 END AS before FROM x)""",
        """SELECT symbol, resolution, seq, 'swing' AS unit, 'found' AS status, CASE WHEN price > before THEN 'higher' ELSE 'lower' END AS what FROM y WHERE before <> price
        UNION ALL SELECT symbol, resolution, seq, 'fragile', CASE WHEN kind = 'low' AND price < least THEN 'algorithm_failed' ELSE 'found' END, CASE WHEN kind = 'low' AND price < least THEN 'ArithmeticError: new low' ELSE kind END FROM y""",
    )
)
def pattern_plugins(spark, sf_dir):
    """Two units over the last six pivots, one of which fails at times."""
    found = S.pivots(moves(spark, sf_dir), KEY)
    return P.run_units(found, KEY, "seq", ["kind", "price"], {"swing": Swing(), "fragile": Fragile()})


@query(
    sql(
        EVENTS,
        """SELECT symbol, min(event_us) AS first_us, max(event_us) + 600000000 AS end_us, count(*) AS events, max(price) AS high, min(price) AS low
        FROM (SELECT *, sum(CASE WHEN event_us - before < 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY event_us, seq) AS session
              FROM (SELECT *, lag(event_us) OVER (PARTITION BY symbol ORDER BY event_us, seq) AS before FROM ev)) GROUP BY symbol, session""",
    )
)
def gap_sessions(spark, sf_dir):
    """Sessions that end where a symbol is silent for ten minutes."""
    e = price_events(spark, sf_dir).withColumn("at", F.timestamp_micros("event_us"))
    s = e.groupBy("symbol", F.session_window("at", "10 minutes").alias("w")).agg(F.count("*").alias("events"), F.max("price").alias("high"), F.min("price").alias("low"))
    return s.select("symbol", F.unix_micros("w.start").alias("first_us"), F.unix_micros("w.end").alias("end_us"), "events", "high", "low")


@query(
    f"""WITH l AS ({ORACLE_SQL["time_window_labels"]})
    SELECT symbol, status, CAST(grouping(symbol) * 2 + grouping(status) AS BIGINT) AS level, count(*) AS labels FROM l GROUP BY GROUPING SETS ((symbol, status), (symbol), (status), ())"""
)
def label_rollup(spark, sf_dir):
    """Labels counted by symbol and status, by each alone, and in all."""
    labels = QUERIES["time_window_labels"](spark, sf_dir)
    sets = [[F.col("symbol"), F.col("status")], [F.col("symbol")], [F.col("status")], []]
    return labels.groupingSets(sets, F.col("symbol"), F.col("status")).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("labels")).select("symbol", "status", "level", "labels")
