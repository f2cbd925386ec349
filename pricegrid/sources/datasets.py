"""Immutable tables whose content is verified: datasets of events, and bundles of a run's results.

A row's leaf is the hash of its canonical form. The digest of a partition is a hash tree over its leaves in which the leaves'
own first characters say where they stand, so it is the same whatever the order, the files and the parallelism: leaves
with equal first characters are hashed together, sorted, and these hashes once more. Only hashes are shuffled, and a group
of a partition holds a few hundred. The partitions' digests are the leaves of the whole's digest, which names the dataset; a
run is named by the hash of all that it was made from.

Data are written first, the manifest after them, and the header last and only if no other is there, so a writer that dies leaves
nothing that counts, and of two writers one wins. Reading compares every partition with the manifest.

Defined results: null values have a form of their own; repeated rows count each; an empty dataset is refused, an empty table of a
bundle is not. Keys that are null are a partition.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.gates import canonical, dataset_violations
from . import files

HEADER, MANIFEST = "header.json", "manifest"


class DatasetError(ValueError):
    """A dataset or bundle was refused; ``code`` says why."""

    def __init__(self, code: str, detail: str = "") -> None:
        self.code = code
        super().__init__(f"{code}: {detail}" if detail else code)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def leaf(columns: list[str]) -> Column:
    return F.sha2(canonical(*columns), 256)


def digests(rows: DataFrame, by: list[str], hashed: Column, levels: tuple[int, ...] = (3,)) -> DataFrame:
    """``by``, rows and digest of each partition; ``hashed`` is a row's leaf.

    ``levels`` are the numbers of first characters by which hashes are put together, from the leaves up; each three of them
    divide a partition by 4,096. Leaves are dealt once, by the fewest of these characters; what an earlier level puts together
    then lies in one task already.
    """
    dealt = rows.select(*by, hashed.alias("__hash")).withColumn("__top", F.substring("__hash", 1, levels[-1])).repartition(*by, "__top")
    nodes = dealt.select(*by, "__top", "__hash", F.lit(1).cast("long").alias("__n"), F.col("__hash").alias("__text"))
    for chars in levels:
        nodes = (
            nodes.groupBy(*by, "__top", F.substring("__hash", 1, chars).alias("__at"))
            .agg(F.sum("__n").alias("__n"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("__text"))), 256).alias("__node"))
            .select(*by, "__top", F.col("__at").alias("__hash"), "__n", F.concat("__at", F.lit(":"), "__node").alias("__text"))
        )
    return nodes.groupBy(*by).agg(F.sum("__n").alias("rows"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("__text"))), 256).alias("digest"))


def partitions(events: DataFrame, keys: list[str], order: str, size: int = 1 << 20) -> DataFrame:
    """``keys``, bucket, rows, digest: partitions of ``size`` successive values of ``order``."""
    bucket = F.call_function("div", F.col(order), F.lit(size)).alias("bucket")
    return digests(events.select("*", bucket), [*keys, "bucket"], leaf(events.columns))


@dataclass(frozen=True)
class Dataset:
    path: str
    header: dict[str, Any]
    manifest: DataFrame
    events: DataFrame

    @property
    def dataset_id(self) -> str:
        return self.header["dataset_id"]

    @property
    def hash(self) -> str:
        """The hash of the whole header, which a run states to say which dataset it expects."""
        return content_hash(self.header)


def _whole(manifest: DataFrame) -> tuple[str, int, int]:
    """(digest, partitions, rows) over a manifest."""
    total = manifest.agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    one = digests(manifest, [], leaf(manifest.columns)).first()
    return (one["digest"], one["rows"], total) if one and one["rows"] else (hashlib.sha256(b"").hexdigest(), 0, total)


def _broken(events: DataFrame, keys: list[str]) -> dict[str, int]:
    """How many rows break which rule of a dataset, which has some rows."""
    rules = ["sequence_not_rising", "time_falling", "known_before_event", "nonpositive_price", "repeated_identity"]
    broken = dataset_violations(events, keys).agg(*[F.sum(c).alias(c) for c in rules], F.sum("rows").alias("rows")).first()
    if not broken["rows"]:
        raise DatasetError("empty_dataset")
    return {c: broken[c] for c in rules if broken[c]}


def write_dataset(events: DataFrame, root: str, *, source: str, units: str, quality: str, keys: list[str] = ["symbol"], order: str = "seq", parent: str | None = None, keep_broken: bool = False) -> Dataset:  # noqa: B006
    """Verify ``events`` and write them under ``root`` by their own digest.

    They need the columns that ``dataset_violations`` looks at. Equal events give the same id, and writing them again the dataset
    that is there. Events that break a rule are refused; with ``keep_broken`` all of them are written as they are, the header counts
    what they break, and a quality of complete becomes partial.
    """
    spark = events.sparkSession
    found = {}
    if not keep_broken and (found := _broken(events, keys)):
        raise DatasetError("invalid_dataset_event", ", ".join(f"{c}={n}" for c, n in found.items()))
    root = files.qualified(spark, root)
    made = f"{root}/data-{uuid.uuid4().hex}"
    bucket = F.call_function("div", F.col(order), F.lit(1 << 20)).alias("bucket")
    by = [f"key_{k}" for k in keys]
    placed = events.select("*", *[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], bucket)
    placed.repartition(*by, "bucket").write.partitionBy(*by, "bucket").parquet(f"{made}/events")
    written = spark.read.schema(events.schema).parquet(f"{made}/events").select(*events.columns)
    if keep_broken and (found := _broken(written, keys)) and quality == "complete":  # they needn't be computed twice
        quality = "partial"
    partitions(written, keys, order).coalesce(1).write.parquet(f"{made}/{MANIFEST}")
    manifest = spark.read.parquet(f"{made}/{MANIFEST}")
    digest, count, rows = _whole(manifest)
    times = written.agg(F.min("event_us").alias("first"), F.max("received_us").alias("last")).first()
    header = {
        "dataset_id": f"dataset:{digest}", "parent_dataset_id": parent, "source": source, "units": units, "quality_status": quality, "timezone": "UTC", "schema_version": 1,
        "order_policy": order, "keys": keys, "columns": events.columns, "partitions": count, "rows": rows, "range_start_us": times["first"], "range_end_us": times["last"], "data": made.rsplit("/", 1)[1],
        **({"violations": found} if found else {}),
    }
    path = f"{root}/{digest}"
    files.put_if_absent(spark, f"{path}/{HEADER}", canonical_json(header))
    return load_dataset(spark, path, verify=False)


def dataset_status(spark: SparkSession, path: str) -> DataFrame:
    """keys, bucket, rows, digest, status of each partition: intact, changed, missing or unexpected. Unreadable files count as absent."""
    d = load_dataset(spark, path, verify=False)
    keys, order = d.header["keys"], d.header["order_policy"]
    raw = spark.read.schema(d.events.schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{_data(path, d.header)}/events").select(*d.header["columns"])
    now = partitions(raw, keys, order)
    met = d.manifest.alias("m").join(now.alias("n"), [F.col(f"m.{k}").eqNullSafe(F.col(f"n.{k}")) for k in [*keys, "bucket"]], "full")
    same = (F.col("m.digest") == F.col("n.digest")) & (F.col("m.rows") == F.col("n.rows"))
    status = F.when(F.col("n.digest").isNull(), "missing").when(F.col("m.digest").isNull(), "unexpected").when(same, "intact").otherwise("changed")
    return met.select(*[F.coalesce(f"m.{c}", f"n.{c}").alias(c) for c in [*keys, "bucket", "rows", "digest"]], status.alias("status"))


def _data(path: str, header: dict[str, Any]) -> str:
    return f"{path.rsplit('/', 1)[0]}/{header['data']}"


def load_dataset(spark: SparkSession, path: str, verify: bool = True) -> Dataset:
    """The dataset at ``path``; with ``verify`` its name, manifest and every partition must fit."""
    path = files.qualified(spark, path)
    text = files.read_text(spark, f"{path}/{HEADER}")
    if text is None:
        raise DatasetError("dataset_missing", path)
    header = json.loads(text)
    made = _data(path, header)
    manifest = spark.read.parquet(f"{made}/{MANIFEST}")
    events = spark.read.parquet(f"{made}/events").select(*header["columns"])
    if verify:
        digest, count, rows = _whole(manifest)
        if header["dataset_id"] != f"dataset:{digest}" or path.rsplit("/", 1)[1] != digest or (count, rows) != (header["partitions"], header["rows"]):
            raise DatasetError("manifest_hash_mismatch")
        bad = dataset_status(spark, path).filter("status <> 'intact'").limit(20).collect()  # enough to name them
        if bad:
            raise DatasetError("partition_hash_mismatch", "; ".join(f"{[r[k] for k in header['keys']]} {r['bucket']} {r['status']}" for r in bad))
    return Dataset(path, header, manifest, events)


@dataclass(frozen=True)
class Bundle:
    path: str
    run_id: str
    spec: dict[str, Any]
    tables: dict[str, DataFrame]
    told: dict[str, dict[str, Any]]  # rows, digest and schema of each table, as the header has them


def run_id(kind: str, spec: dict[str, Any]) -> str:
    """What a run is named by: its kind and all that it was made from (dataset hash, configuration, versions)."""
    return f"{kind}-{content_hash(spec)}"


def write_bundle(spark: SparkSession, root: str, kind: str, spec: dict[str, Any], tables: dict[str, DataFrame]) -> Bundle:
    """Write a run's tables with their digests; a run that is there already is refused, whoever wrote it."""
    root, name = files.qualified(spark, root), run_id(kind, spec)
    path, made = f"{root}/{name}", f"{root}/data-{uuid.uuid4().hex}"
    if files.read_text(spark, f"{path}/{HEADER}") is not None:
        raise DatasetError("run_exists", name)
    told = {}
    for table, df in tables.items():
        df.write.parquet(f"{made}/{table}")
        told[table] = _table_digest(spark.read.schema(df.schema).parquet(f"{made}/{table}"))
    header = {"run_id": name, "kind": kind, "spec": spec, "tables": told, "data": made.rsplit("/", 1)[1]}
    if not files.put_if_absent(spark, f"{path}/{HEADER}", canonical_json(header)):
        raise DatasetError("run_exists", name)
    return load_bundle(spark, path, verify=False)


def _table_digest(df: DataFrame) -> dict[str, Any]:
    one = digests(df, [], leaf(df.columns), levels=(6, 3)).first()
    return {"rows": one["rows"] or 0, "digest": one["digest"], "schema": df.schema.json()}


def load_bundle(spark: SparkSession, path: str, verify: bool = True) -> Bundle:
    """The run at ``path``; with ``verify`` its id and every table must fit what the header says."""
    path = files.qualified(spark, path)
    text = files.read_text(spark, f"{path}/{HEADER}")
    if text is None:
        raise DatasetError("run_missing", path)
    header = json.loads(text)
    made = _data(path, header)
    tables = {t: spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{made}/{t}") for t, told in header["tables"].items()}
    if verify:
        if not header["run_id"] == run_id(header["kind"], header["spec"]) == path.rsplit("/", 1)[1]:
            raise DatasetError("bundle_run_id_mismatch")
        for t, told in header["tables"].items():
            raw = spark.read.schema(tables[t].schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{made}/{t}")
            if _table_digest(raw) != told:
                raise DatasetError("bundle_table_mismatch", t)
    return Bundle(path, header["run_id"], header["spec"], tables, header["tables"])


def run_input_codes(dataset: Dataset, expected_hash: str, policy: dict[str, float], costs: dict[str, float], signals: DataFrame | None = None) -> list[str]:
    """Why a run over ``dataset`` is refused, in the order of the checks; none where it may start.

    ``signals`` (signal_id, symbol, side, occurrence_us, confirmation_us, decision_us) must be unique, of the dataset's
    symbols, known before they are decided, and decided within the dataset's range.
    """
    out = []
    if dataset.hash != expected_hash:
        out.append("dataset_hash_mismatch")
    if dataset.header["quality_status"] not in ("complete", "partial"):
        out.append("dataset_quality_unknown")
    finite = lambda v: v == v and abs(v) != float("inf")
    if not all(finite(policy[k]) and policy[k] > 0 for k in ("size", "stop_distance")) or policy["entry_delay"] < 0 or policy["exit_delay"] < 1:
        out.append("invalid_execution_policy")
    if not all(finite(c) and c >= 0 for c in costs.values()):
        out.append("invalid_cost_policy")
    if signals is not None:
        known = dataset.manifest.select(F.col(dataset.header["keys"][0]).alias("symbol")).distinct().withColumn("known", F.lit(True))
        in_order = (F.col("occurrence_us") <= F.col("confirmation_us")) & (F.col("confirmation_us") <= F.col("decision_us"))
        in_range = F.col("decision_us").between(dataset.header["range_start_us"], dataset.header["range_end_us"])
        ok = F.coalesce(in_order & in_range & F.col("side").isin("long", "short") & F.col("known"), F.lit(False))
        bad = signals.join(known, "symbol", "left").filter(~ok).limit(1).count()
        if bad or signals.groupBy("signal_id").count().filter("count > 1").limit(1).count():
            out.append("invalid_signal_provenance")
    return out
