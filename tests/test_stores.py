"""Datasets, bundles and the journal: content is verified, one of two writers wins, nothing half written counts."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from pricegrid.sources import datasets, files, journal
from pricegrid.sources.events import price_events

ROW = "symbol string, seq long, source_sequence long, event_us long, received_us long, raw long, price long"


def events(spark, n=50, symbols=("a", "b|=c")):
    return spark.createDataFrame([(s, i + 1, i + 1, i * 10, i * 10 + 5, i, 100 + i) for s in symbols for i in range(n)], ROW)


def write(df, root, **how):
    return datasets.write_dataset(df, str(root), **{"source": "feed", "units": "price", "quality": "complete", **how})


def data_files(path, header):
    top = os.path.join(os.path.dirname(path.removeprefix("file:")), header["data"], "events")
    return sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_order_and_layout_do_not_change_the_name(spark, tmp_path):
    df = events(spark)
    one, two = write(df, tmp_path / "x"), write(df.orderBy(F.rand(3)).repartition(7), tmp_path / "y")
    assert one.dataset_id == two.dataset_id
    assert write(df.withColumn("price", F.col("price") + (F.col("seq") == 9).cast("long")), tmp_path / "z").dataset_id != one.dataset_id
    back = datasets.load_dataset(spark, one.path)
    assert sorted(map(tuple, back.events.collect())) == sorted(map(tuple, df.collect()))
    assert back.header["rows"] == 100 and (back.header["range_start_us"], back.header["range_end_us"]) == (0, 495)
    assert write(df, tmp_path / "x").path == one.path  # again: the one that is there


def test_a_flipped_byte_names_its_partition(spark, tmp_path):
    made = write(events(spark), tmp_path)
    victim = next(f for f in data_files(made.path, made.header) if "key_symbol=a" in f)
    raw = bytearray(open(victim, "rb").read())
    raw[len(raw) // 3] ^= 1
    open(victim, "wb").write(raw)
    crc = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    status = {r["symbol"]: r["status"] for r in datasets.dataset_status(spark, made.path).collect()}
    assert status["b|=c"] == "intact" and status["a"] in ("changed", "missing")
    with pytest.raises(datasets.DatasetError, match="partition_hash_mismatch.*'a'"):
        datasets.load_dataset(spark, made.path)


def test_lost_rows_and_forged_headers_are_found(spark, tmp_path):
    made = write(events(spark), tmp_path / "x")
    for f in data_files(made.path, made.header):
        if "key_symbol=a" in f:
            os.unlink(f)
    assert {r["symbol"]: r["status"] for r in datasets.dataset_status(spark, made.path).collect()} == {"a": "missing", "b|=c": "intact"}
    other = write(events(spark, 20), tmp_path / "y")
    at = other.path.removeprefix("file:") + "/header.json"
    text = open(at).read().replace(other.dataset_id, "dataset:" + "0" * 64)
    open(at, "w").write(text)
    with pytest.raises(datasets.DatasetError, match="manifest_hash_mismatch"):
        datasets.load_dataset(spark, other.path)
    with pytest.raises(datasets.DatasetError, match="dataset_missing"):
        datasets.load_dataset(spark, str(tmp_path / "nowhere"))


def test_broken_events_are_refused(spark, tmp_path):
    df = events(spark, 10, ("a",))
    with pytest.raises(datasets.DatasetError, match="empty_dataset"):
        write(df.limit(0), tmp_path)
    for column, rule in (("price", "nonpositive_price"), ("received_us", "known_before_event"), ("source_sequence", "sequence_not_rising"), ("event_us", "time_falling")):
        broken = df.withColumn(column, F.when(F.col("seq") == 7, F.lit(-9).cast("long")).otherwise(F.col(column)))
        with pytest.raises(datasets.DatasetError, match=rule):
            write(broken, tmp_path)


def test_bundles(spark, tmp_path):
    trades = spark.createDataFrame([(1, "long", None), (1, "long", None), (2, "short", 5)], "seq long, side string, net long")
    spec = {"dataset": "d", "costs": {"spread": 1}}
    run = datasets.write_bundle(spark, str(tmp_path), "backtest", spec, {"trades": trades, "none": trades.limit(0)})
    assert run.run_id == datasets.run_id("backtest", {"costs": {"spread": 1}, "dataset": "d"})
    back = datasets.load_bundle(spark, run.path)
    assert back.tables["trades"].count() == 3 and back.tables["none"].count() == 0
    with pytest.raises(datasets.DatasetError, match="run_exists"):
        datasets.write_bundle(spark, str(tmp_path), "backtest", spec, {"trades": trades})
    made = os.path.join(str(tmp_path), next(n for n in os.listdir(tmp_path) if n.startswith("data-")))
    trades.limit(2).write.mode("overwrite").parquet(f"{made}/trades")
    with pytest.raises(datasets.DatasetError, match="bundle_table_mismatch: trades"):
        datasets.load_bundle(spark, run.path)
    at = run.path.removeprefix("file:") + "/header.json"
    text = open(at).read().replace('"spread":1', '"spread":2')
    open(at, "w").write(text)
    with pytest.raises(datasets.DatasetError, match="bundle_run_id_mismatch"):
        datasets.load_bundle(spark, run.path)


def test_why_a_run_is_refused(spark, tmp_path):
    made = write(events(spark), tmp_path)
    policy, costs = {"size": 1.0, "stop_distance": 2.0, "entry_delay": 0, "exit_delay": 1}, {"spread": 0.0}
    signals = spark.createDataFrame([("1", "a", "long", 5, 6, 7), ("2", "a", "short", 7, 7, 7)], "signal_id string, symbol string, side string, occurrence_us long, confirmation_us long, decision_us long")
    assert datasets.run_input_codes(made, made.hash, policy, costs, signals) == []
    assert datasets.run_input_codes(made, "x", policy | {"size": float("nan")}, {"spread": -1.0}) == ["dataset_hash_mismatch", "invalid_execution_policy", "invalid_cost_policy"]
    for broken in (signals.withColumn("signal_id", F.lit("1")), signals.withColumn("symbol", F.lit("z")), signals.withColumn("decision_us", F.lit(6).cast("long")), signals.withColumn("side", F.lit(None).cast("string"))):
        assert datasets.run_input_codes(made, made.hash, policy, costs, broken) == ["invalid_signal_provenance"]
    unknown = write(events(spark, 5), tmp_path / "u", quality="unknown")
    assert datasets.run_input_codes(unknown, unknown.hash, policy, costs) == ["dataset_quality_unknown"]


def kept(spark, *rows):
    return spark.createDataFrame(list(rows), "stream string, event_key string, payload string")


def test_expected_counts(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journal.append(spark, path, kept(spark, ("s", "a", "1"), ("s", "b", "2"), ("t", "a", "3")), 0, expected_count={"s": 0, "t": 0}) == 3
    with pytest.raises(journal.JournalConflict, match="journal_concurrent_write"):
        journal.append(spark, path, kept(spark, ("s", "c", "4")), 1, expected_count={"s": 1})
    assert journal.append(spark, path, kept(spark, ("s", "b", "2")), 1, expected_count={"s": 0}) == 0  # nothing new, nothing to refuse
    assert journal.append(spark, path, kept(spark, ("s", "c", "4")), 1, expected_count={"s": 2}) == 1
    assert [(r["event_key"], r["sequence"]) for r in journal.read(spark, path).filter("stream = 's'").orderBy("sequence").collect()] == [("a", 1), ("b", 2), ("c", 4)]
    assert journal.row_identity(spark, path, "s", 4)[0] == "c" and journal.row_identity(spark, path, "t", 4) is None
    assert journal.count_through(spark, path, "s", 3) == 2 and journal.sequence_of(spark, path, "t", "a") == 3 and journal.sequence_of(spark, path, "t", "z") is None
    assert journal.backup(spark, path, str(tmp_path / "copy")) == 4 and journal.verified(spark, str(tmp_path / "copy")).count() == 4
    with pytest.raises(journal.JournalConflict, match="backup_destination_exists"):
        journal.backup(spark, path, str(tmp_path / "copy"))


def test_of_two_concurrent_writers_one_succeeds(spark, tmp_path):
    path, out = str(tmp_path / "j"), []
    journal.append(spark, path, kept(spark, ("s", "a", "1")), 0)

    def writer(k):
        try:
            out.append(journal.append(spark, path, kept(spark, ("s", f"k{k}", "x")), k, expected_count={"s": 1}))
        except journal.JournalConflict as e:
            out.append(str(e))

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, out)) == ["1", "journal_concurrent_write"]
    assert journal.read(spark, path).count() == 2
    both = [threading.Thread(target=lambda k=k: out.append(journal.append(spark, path, kept(spark, ("u", f"k{k}", "x")), k))) for k in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert journal.read(spark, path).filter("stream = 'u'").count() == 2  # without an expectation both are kept, one after another
    assert sorted(r["sequence"] for r in journal.read(spark, path).collect()) == [1, 2, 3, 4]


def test_only_committed_rows_count(spark, tmp_path):
    path = str(tmp_path / "j")
    journal.append(spark, path, kept(spark, ("s", "a", "1")), 0)
    kept(spark, ("s", "dead", "1")).selectExpr("stream", "event_key", "'h' AS content_hash", "payload", "1L AS batch", "9L AS sequence").write.parquet(f"{path}/data/dead")
    assert journal.read(spark, path).count() == 1
    folder = journal.commits(spark, path)[0]["folder"]
    journal.read(spark, path).withColumn("payload", F.lit("changed")).coalesce(1).write.parquet(str(tmp_path / "forged"))
    os.rename(f"{path}/data/{folder}", str(tmp_path / "old"))
    os.rename(str(tmp_path / "forged"), f"{path}/data/{folder}")
    with pytest.raises(journal.JournalCorrupt):
        journal.verified(spark, path)


def test_put_if_absent(spark, tmp_path):
    for path in (f"{tmp_path}/f.json", f"file://{tmp_path}/g.json"):
        assert files.put_if_absent(spark, path, "é1") and not files.put_if_absent(spark, path, "2")
        assert files.read_text(spark, path) == "é1"
    assert files.names(spark, str(tmp_path)) == ["f.json", "g.json"] and files.names(spark, f"{tmp_path}/none") == [] and files.read_text(spark, f"{tmp_path}/none") is None


def test_whole_events_round_trip(spark, small, tmp_path):
    e = price_events(spark, small).select("symbol", "seq", "source_sequence", "event_us", "received_us", "raw", "price")
    made = write(e, tmp_path)
    assert datasets.load_dataset(spark, made.path).events.exceptAll(e).count() == 0


def test_events_that_break_rules_are_kept_and_counted_if_asked(spark, tmp_path):
    df = events(spark, 10, ("a",)).withColumn("price", F.when(F.col("seq") == 7, F.lit(-9).cast("long")).otherwise(F.col("price")))
    made = write(df, tmp_path, keep_broken=True)
    assert made.header["violations"] == {"nonpositive_price": 1} and made.header["quality_status"] == "partial"
    assert sorted(map(tuple, datasets.load_dataset(spark, made.path).events.collect())) == sorted(map(tuple, df.collect()))
    assert "violations" not in write(events(spark, 10), tmp_path, keep_broken=True).header


def test_a_feed_that_falls_to_zero_or_goes_back_in_time_is_stored_whole(spark, small, tmp_path):
    """Twice the events, the second time with later ids, almost the same times (equal ones would leave fills open), and values so large that the walk falls below zero."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    e = spark.read.parquet(f"{small}/events.parquet")
    again = e.withColumn("event_id", F.col("event_id") + 100_000).withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 MICROSECONDS")).withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("value") * 1000))
    e.unionByName(again).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("dataset_store", "run_bundle"):
        got = queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_a_run_reads_its_dataset(spark, small, tmp_path, monkeypatch):
    """Trades come from the events that name the run, not from the tables once more; a run without trades has no count and no digest, as in SQL."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from pricegrid.plans import research

    def once_more(*_):
        raise AssertionError("the events were derived once more")

    known = queries()["run_bundle"]
    monkeypatch.setattr(research, "price_events", once_more)
    e = spark.read.parquet(f"{small}/events.parquet")
    for n, rows in (("all", e), ("few", e.filter("event_id < 5"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/{n}/events.parquet/*.parquet')")
        got = known(spark, f"{tmp_path}/{n}")
        assert list(map(tuple, got.collect())) == con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['run_bundle']})").fetchall(), n


def test_kept_events_are_computed_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    assert write(events(spark, 20).mapInArrow(count, ROW), tmp_path, keep_broken=True).header["rows"] == 40 and made.value == 40
    with pytest.raises(datasets.DatasetError, match="empty_dataset"):
        write(events(spark, 20).limit(0), tmp_path / "none", keep_broken=True)
    assert not os.path.exists(tmp_path / "none" / "header.json")


def test_leaves_are_dealt_once(spark):
    """Several levels of the tree come from one shuffle of the leaves; the digest is the one that a plain loop finds."""
    import hashlib
    from itertools import groupby

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    df = spark.range(3_000).select((F.col("id") % 2_900).alias("id"))
    one = datasets.digests(df, [], datasets.leaf(["id"]), levels=(2, 1))
    assert one._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    texts = heads = sorted(sha(f"id={i % 2_900}") for i in range(3_000))
    for chars in (2, 1):
        pairs = [(at, list(g)) for at, g in groupby(zip([h[:chars] for h in heads], texts, strict=True), key=lambda p: p[0])]
        heads = [at for at, _ in pairs]
        texts = [f"{at}:{sha(''.join(sorted(t for _, t in g)))}" for at, g in pairs]
    assert tuple(one.first()) == (3_000, sha("".join(sorted(texts))))


def test_an_append_groups_its_rows_once(spark, tmp_path, monkeypatch):
    """What is appended is computed once, however many steps look at it; null payloads are a content of their own."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "stream string, event_key string, payload string"
    rows = spark.createDataFrame([("s", str(i), f"p{i}") for i in range(20)] + [("s", "none", None)], schema).mapInArrow(count, schema)
    assert journal.append(spark, str(tmp_path), rows, 1) == 21 and made.value == 21
    for payload in ("other", None):
        twice = spark.createDataFrame([("t", "k", "x"), ("t", "k", payload)], schema)
        with pytest.raises(journal.JournalConflict):
            journal.append(spark, str(tmp_path), twice, 2)
    assert journal.read(spark, str(tmp_path)).count() == 21
