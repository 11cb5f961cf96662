"""Checks as data: each a predicate that tells bad rows; all of a table's in one pass, with the first offenders, or watched while it is written."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Offenders that are named.
SAMPLE = 5
COLUMNS = "section string, check_name string, n_rows long, n_bad long, sample array<string>"


@dataclass(frozen=True)
class Rule:
    """``bad`` is an SQL predicate over a row; where it is null the row isn't bad."""

    section: str
    name: str
    bad: str


def _counted(rules: tuple[Rule, ...]):
    """Of a task's rows (key of a bad one, else null; bit k if rule k finds it bad) one row for each rule: it can be added to those of other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bad, least = 0, [0] * len(rules), [[] for _ in rules]
        for batch in batches:
            rows += len(batch)
            found = batch.filter(pc.is_valid(batch.column("key")))
            for k in range(len(rules)) if len(found) else ():
                own = found.column("key").filter(pc.not_equal(pc.bit_wise_and(found.column("bits"), 1 << k), 0))
                bad[k] += len(own)
                if len(own):
                    first = own.take(pc.array_sort_indices(own)[:SAMPLE]).to_pylist()
                    least[k] = heapq.nsmallest(SAMPLE, [*least[k], *first], key=str.encode)
        yield pa.record_batch(
            [pa.array([r.section for r in rules]), pa.array([r.name for r in rules]), pa.array([rows] * len(rules), pa.int64()), pa.array(bad, pa.int64()), pa.array(least, pa.list_(pa.string()))],
            ["section", "check_name", "n_rows", "n_bad", "sample"],
        )

    return run


def checked(df: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    """section, check_name, n_rows, n_bad and sample (the ``SAMPLE`` least keys of bad rows) of each rule, in one pass over ``df``.

    ``key`` is an SQL expression that names a row. Tasks count for themselves and keep the least keys, and only these few rows are shuffled.
    An empty table has no bad rows. At most 63 rules.
    """
    if len(rules) > 63:
        raise ValueError("at most 63 rules in one pass")
    flags = [F.when(F.expr(r.bad), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    bits = reduce(lambda a, b: a.bitwiseOR(b), flags)
    rows = df.select(bits.alias("bits"), F.expr(key).cast("string").alias("key")).select("bits", F.when(F.col("bits") != 0, F.coalesce("key", F.lit("null"))).alias("key"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("sample"))), 1, SAMPLE)
    # a row for each rule, whatever the table: one without rows has no tasks
    none = df.sparkSession.createDataFrame([(r.section, r.name, 0, 0, []) for r in rules], COLUMNS)
    return rows.mapInArrow(_counted(rules), COLUMNS).unionByName(none).groupBy("section", "check_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"), merged.alias("sample"))


def repeated(df: DataFrame, section: str, keys: list[str], name: str = "duplicate_key") -> DataFrame:
    """The check that ``keys`` are unique, as a row like those of ``checked``: n_rows different keys, n_bad repeated ones. A null counts as a value."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("times"))
    text = "concat_ws(':', " + ", ".join(f"coalesce(cast({k} as string), 'null')" for k in keys) + ")"
    return checked(groups, (Rule(section, name, "times > 1"),), text)


def present(spark: SparkSession, sf_dir: str, needed: dict[str, list[str]]) -> DataFrame:
    """Whether tables exist, have rows and all their columns; what is missing makes a row, not an error, and its later checks fail with it."""
    out = []
    for name, columns in needed.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            facts = (False, 0, sorted(columns))
        else:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            facts = (True, len(df.take(1)), sorted(set(columns) - set(df.columns)))
        there, rows, missing = facts
        out += [
            ("tables", f"{name}_missing", 1, int(not there), [] if there else [name]), ("tables", f"{name}_empty", 1, int(not rows), [] if rows else [name]),
            ("tables", f"{name}_columns", len(columns), len(missing), missing[:SAMPLE]),
        ]
    return spark.createDataFrame(out, COLUMNS)


def watched(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, Observation]:
    """``df`` whose rows are counted against the rules by whatever writes it, and the observation that has n_rows and, by name, the bad ones afterwards."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.expr(r.bad)).alias(r.name) for r in rules]), seen


def outcome(found: DataFrame) -> DataFrame:
    """``checked`` rows with a status and the sample as one text."""
    status = F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL")
    return found.select("section", "check_name", "n_rows", "n_bad", status.alias("status"), F.array_join("sample", ",").alias("sample"))


def report(found: DataFrame) -> DataFrame:
    """section, n_checks, n_failed and status of each section, and of ``all``."""
    each = found.select(F.explode(F.array("section", F.lit("all"))).alias("section"), (F.col("n_bad") > 0).alias("failed"))
    return each.groupBy("section").agg(F.count("*").alias("n_checks"), F.count_if("failed").alias("n_failed")).withColumn("status", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))
