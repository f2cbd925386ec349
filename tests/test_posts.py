"""Posts against a watch-list, and completeness, on odd rows."""

from pricegrid.operators import gates as G
from pricegrid.operators import hygiene as H


def test_recent_posts(spark):
    rows = [(1, 7, 10, "s"), (2, 7, 10, "t"), (3, 8, 11, "s"), (4, 8, 11, None), (5, 7, 9, "s"), (6, 7, None, "s"), (7, None, 12, "s"), (8, 7, 10, "s")]
    posts = spark.createDataFrame(rows, "id int, account int, at long, symbol string")
    watched = spark.createDataFrame([(7, "x"), (7, "y"), (None, "z")], "account int, symbol string")
    since = spark.createDataFrame([(10,)], "since long")
    got = {r.id: (r.relevant, r.score, r.reasons) for r in G.recent_posts(posts, watched, since, ["s"]).collect()}
    both = (True, 1, "account_match,symbol_match")
    assert got == {1: both, 8: both, 2: (True, 1, "account_match"), 3: (False, 0, "symbol_match"), 4: (False, 0, "no_watchlist_match"), 7: (False, 0, "symbol_match")}
    assert not any(r.relevant for r in G.recent_posts(posts, watched.limit(0), since, ["s"]).collect())
    assert G.recent_posts(posts, watched, since.limit(0), ["s"]).collect() == [] == G.recent_posts(posts.limit(0), watched, since, ["s"]).collect()


def test_completeness(spark):
    rows = [("a", 1, None), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("b", 1, False), (None, 1, True)]
    df = spark.createDataFrame(rows, "symbol string, arrival long, is_gap boolean")
    for width in (1, 2, 100):
        got = {(r.symbol, r.arrival): r.completeness for r in H.completeness(df, ["symbol"], ["arrival"], width).collect()}
        assert got == {(s, n): "partial" if (s, n) in (("a", 3), ("a", 4), (None, 1)) else "complete" for s, n, _ in rows}
    assert H.completeness(df.limit(0), ["symbol"], ["arrival"]).collect() == []
