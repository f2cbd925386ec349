"""Pieces of DuckDB SQL that the oracles share; each is a list of named subqueries without WITH."""

from __future__ import annotations

RESOLUTIONS = {"fast": 5_000, "medium": 10_000, "slow": 20_000}
REVERSAL = 3
STRUCTURE = "fast"

EVENTS = """
e0 AS (
  SELECT event_type AS symbol, event_id AS source_sequence, epoch_us(ts) AS event_us,
         epoch_us(ts) + 10000 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS received_us, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
ev AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY source_sequence) AS seq, source_sequence, event_us, received_us, cents * 10 AS raw,
         10000000 + CAST(sum(CASE WHEN source_sequence % 2 = 0 THEN cents ELSE -cents END)
                         OVER (PARTITION BY symbol ORDER BY source_sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS price
  FROM e0)"""

ARRIVALS = (
    EVENTS
    + """,
idd AS (SELECT *, 'feed:' || symbol || ':tick:mid:sequence:' || source_sequence AS identity_key FROM ev),
arr AS (
  SELECT *, CASE WHEN source_sequence % 89 = 0 THEN seq * 10 + 55 ELSE seq * 10 END AS arrival FROM idd
  UNION ALL SELECT *, seq * 10 + 503 FROM idd WHERE source_sequence % 97 = 0),
b4 AS (
  SELECT *, max(source_sequence) OVER p AS hi, max(event_us) OVER p AS ht,
         row_number() OVER (PARTITION BY symbol, identity_key ORDER BY arrival, source_sequence) AS nth
  FROM arr WINDOW p AS (PARTITION BY symbol ORDER BY arrival, source_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flags AS (
  SELECT symbol, seq, source_sequence, event_us, received_us, raw, price, identity_key, arrival, nth > 1 AS is_duplicate, hi,
         coalesce(source_sequence < hi, false) OR coalesce(event_us < ht, false) AS is_out_of_order,
         coalesce(source_sequence > hi + 1, false) AS is_gap, CASE WHEN source_sequence > hi + 1 THEN hi + 1 END AS gap_from_sequence, ht
  FROM b4)"""
)

QUOTES = (
    EVENTS
    + """,
q AS (
  SELECT symbol, seq, source_sequence, event_us, received_us,
    CASE WHEN source_sequence % 101 = 0 THEN 0 WHEN source_sequence % 103 = 0 THEN NULL ELSE raw - source_sequence % 7 * 10 END AS bid,
    CASE WHEN source_sequence % 107 = 0 THEN raw - source_sequence % 7 * 10 - 10 ELSE raw + source_sequence % 7 * 10 END AS ask,
    CASE WHEN source_sequence % 3 = 0 THEN raw END AS last
  FROM ev)"""
)

#: The columns as a recursion over each symbol's and resolution's events.
MOVES = (
    EVENTS
    + """,
res(resolution, box) AS (VALUES """
    + ", ".join(f"('{n}', CAST({b} AS BIGINT))" for n, b in RESOLUTIONS.items())
    + """),
walk AS (
  SELECT ev.symbol, r.resolution, r.box, ev.seq, ev.event_us, ev.price AS seed, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS BIGINT) AS edge,
         0 AS column_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS from_price, CAST(0 AS BIGINT) AS boxes
  FROM ev, res r WHERE ev.seq = 1
  UNION ALL
  SELECT symbol, resolution, box, seq, event_us, seed,
    CASE WHEN kind IS NULL THEN direction WHEN kind = 'seed' THEN CASE WHEN ahead > 0 THEN 'X' ELSE 'O' END
         WHEN kind = 'reversal' THEN CASE direction WHEN 'X' THEN 'O' ELSE 'X' END ELSE direction END,
    CASE WHEN kind IS NULL THEN edge
         WHEN kind = 'seed' THEN seed + sign(ahead) * n * box
         WHEN (direction = 'X') = (kind = 'extension') THEN edge + n * box ELSE edge - n * box END,
    column_id + CASE WHEN kind IN ('seed', 'reversal') THEN 1 ELSE 0 END,
    kind, CASE WHEN kind = 'seed' THEN seed WHEN kind IS NOT NULL THEN edge END, CASE WHEN kind IS NULL THEN 0 ELSE n END
  FROM (
    SELECT *, CASE WHEN direction IS NULL THEN CASE WHEN n >= 1 THEN 'seed' END
                   WHEN ahead >= box THEN 'extension' WHEN -ahead >= """
    + str(REVERSAL)
    + """ * box THEN 'reversal' END AS kind
    FROM (
      SELECT *, abs(ahead) // box AS n
      FROM (
        SELECT w.symbol, w.resolution, w.box, e.seq, e.event_us, w.seed, w.direction, w.edge, w.column_id,
               CASE WHEN w.direction IS NULL THEN e.price - w.seed WHEN w.direction = 'X' THEN e.price - w.edge ELSE w.edge - e.price END AS ahead
        FROM walk w JOIN ev e ON e.symbol = w.symbol AND e.seq = w.seq + 1)))),
moves AS (
  SELECT symbol, resolution, seq, event_us, kind, CAST(column_id AS BIGINT) AS column_id, direction, from_price, CAST(edge AS BIGINT) AS to_price, boxes, box,
         row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq) AS k
  FROM walk WHERE kind IS NOT NULL)"""
)

PIVOTS = (
    MOVES
    + """,
near AS (
  SELECT symbol, resolution, seq AS confirmed_seq, event_us AS confirmed_us, k AS confirmed_k, to_price AS rt,
         lag(to_price) OVER w AS price, lag(to_price, 2) OVER w AS lt, lag(seq) OVER w AS seq, lag(event_us) OVER w AS event_us, lag(column_id) OVER w AS column_id
  FROM moves WINDOW w AS (PARTITION BY symbol, resolution ORDER BY seq)),
piv AS (
  SELECT symbol, resolution, seq, event_us, CASE WHEN price > lt THEN 'high' ELSE 'low' END AS kind, price, column_id, confirmed_seq, confirmed_us, confirmed_k
  FROM near WHERE (price > lt AND price > rt) OR (price < lt AND price < rt))"""
)

MATRIX = (
    MOVES
    + """,
grid AS (
  SELECT ev.symbol, ev.seq, r.resolution, m.direction, last_value(m.seq IGNORE NULLS) OVER w AS last_seq, last_value(m.direction IGNORE NULLS) OVER w AS d
  FROM ev CROSS JOIN res r LEFT JOIN moves m ON m.symbol = ev.symbol AND m.seq = ev.seq AND m.resolution = r.resolution
  WINDOW w AS (PARTITION BY ev.symbol, r.resolution ORDER BY ev.seq ROWS UNBOUNDED PRECEDING)),
agg AS (
  SELECT symbol, seq, count(*) FILTER (WHERE d = 'X' AND seq - last_seq < 5) AS bullish, count(*) FILTER (WHERE d = 'O' AND seq - last_seq < 5) AS bearish,
         count(*) FILTER (WHERE seq - last_seq >= 5) AS stale, count(*) FILTER (WHERE last_seq IS NULL) AS warmup
  FROM grid GROUP BY ALL),
mat AS (
  SELECT *, CASE WHEN bullish + bearish < 3 THEN 'unavailable' WHEN bullish = 3 THEN 'aligned_bullish' WHEN bearish = 3 THEN 'aligned_bearish' ELSE 'mixed' END AS alignment,
         CAST(CASE WHEN bullish + bearish < 3 THEN 0 WHEN bullish = 3 OR bearish = 3 THEN 3 ELSE abs(bullish - bearish) END AS BIGINT) AS strength
  FROM agg)"""
)


def sql(pieces: str, *more: str) -> str:
    """The named subqueries and, last, the SELECT; a piece that goes on with a comma continues the list."""
    *rest, select = more
    return f"WITH RECURSIVE {pieces}{''.join(rest)}\n{select}"
