"""Files in and out: typed Parquet, plain and semicolon CSV, nested JSON."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, StructType

from strandline.functions import text


def read_parquet(spark: SparkSession, path: str, schema: StructType, dates: list[str] = ()) -> DataFrame:
    """The columns of ``schema``; those in ``dates`` become dates, null where they can't be. A missing file is an error."""
    df = spark.read.parquet(path)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(*[F.try_to_date(F.col(f.name).cast("string")).alias(f.name) if f.name in dates and not isinstance(df.schema[f.name].dataType, DateType) else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


#: Separators that a header is searched for, and the column that tells a row's place.
SEPARATORS, PLACE = ",;\t|", "place "


def found_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first header line has most of, outside quotes; a comma if it has none."""
    line = spark.read.text(path).take(1)
    bare = re.sub(r'"[^"]*"', "", line[0].value) if line else ""
    return max(SEPARATORS, key=bare.count)


def _placed(df: DataFrame) -> DataFrame:
    """Adds a row's place: its file, where its split begins, and its number within that. Rows of a later place come later in the files, however they are dealt out afterwards."""
    return df.withColumn(PLACE, F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def first_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (with ``PLACE``) that agree on ``keys`` the first in the files, without its place."""
    rest = [c for c in df.columns if c not in (*keys, PLACE)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(F.col(f"`{PLACE}`"), *rest), F.col(f"`{PLACE}`")).alias("r ")).select(*keys, *[F.col("`r `")[c].alias(c) for c in rest])


def read_csv(spark: SparkSession, path: str, sep: str | None = ",", placed: bool = False) -> DataFrame:
    """All columns as text, headers trimmed, lower-cased and without a byte-order mark; without ``sep`` it is found out. ``placed`` adds ``PLACE``, see ``first_wins``."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep or found_separator(spark, path), multiLine=True, escape='"')
    names = [c.lstrip("\ufeff").strip().lower() for c in df.columns]
    return _placed(df).toDF(*names, PLACE) if placed else df.toDF(*names)


def write_csv(df: DataFrame, path: str, sep: str = ",", mark: bool = False) -> None:
    """``mark`` puts a byte-order mark before each file's header, as spreadsheets want it."""
    df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"')


def write_staged(df: DataFrame, path: str) -> None:
    """All or nothing: written beside ``path`` and then moved there, so a job that fails leaves what was there before."""
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    try:
        df.write.parquet(fresh.toString())
    except Exception:
        system.delete(fresh, True)
        raise
    if system.exists(to):
        system.rename(to, old)
    if not system.rename(fresh, to):
        raise OSError(f"{fresh} could not be moved to {path}")
    system.delete(old, True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose ``keys`` aren't recorded yet, the first of each key; running it again appends nothing."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = df.dropDuplicates(keys)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


#: The rows that vendors' JSON files hold.
HISTORY = "date string, open double, high double, low double, close double, adjusted_close double, volume double"
DIVIDENDS, SPLITS = "date string, value double, currency string", "date string, split string"
ROSTER = "Code string, Name string, Type string, Currency string, Isin string"


#: Why a file, or a row of one, is turned away.
CORRUPT, ERROR, NO_ARRAY, NO_OBJECT = "not_json", "error_object", "not_an_array", "row_is_not_an_object"


def read_payloads(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``fields``, security_id from the file's name, ``PLACE``) of files that are each an array of objects, and what was turned away: security_id, reason, detail.

    A file that isn't JSON, is an object (an error, with its message, or any other) or a single value, and a row that isn't an object, are turned away; the rest of the file stays. An empty array has neither.
    A field that can't be read as its type is null, and numbers may be written as texts. A file is one value in memory, so this is for payloads of one security or exchange each.
    """
    name = F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))
    files = spark.read.option("wholetext", True).text(path).select(name.alias("security_id"), F.col("_metadata.file_path").alias("path"), "value", F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    message = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in ("error.message", "error", "message", "errors")])
    why = F.when(F.col("v").isNull(), CORRUPT).when(kind.startswith("OBJECT") & message.isNotNull(), ERROR).when(~kind.startswith("ARRAY"), NO_ARRAY)
    told = files.withColumn("reason", why)
    turned = told.where("reason is not null").select("security_id", "reason", F.coalesce(F.when(F.col("reason") == ERROR, message), F.substring("value", 1, 200)).alias("detail"))
    each = _exploded(told.where("reason is null"))
    object_ = F.schema_of_variant("one").startswith("OBJECT")
    bad = each.where(~object_).select("security_id", F.lit(NO_OBJECT).alias("reason"), F.substring(F.to_json("one"), 1, 200).alias("detail"))
    own = [F.try_variant_get("one", f"$.{c}", t).alias(c) for c, t in (f.split() for f in fields.split(", "))]
    place = F.struct("path", F.lit(0).cast("long").alias("start"), F.col("pos").cast("long").alias("row")).alias(PLACE)
    return each.where(object_).select(*own, "security_id", place), turned.unionByName(bad)


def _exploded(files: DataFrame) -> DataFrame:
    """security_id, path, pos and one (a variant) for each element of the arrays ``v``."""
    files.createOrReplaceTempView(view := f"payloads_{uuid.uuid4().hex}")
    return files.sparkSession.sql(f"select p.security_id, p.path, e.pos, e.value as one from {view} p, lateral variant_explode(p.v) e")


def _payload(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return read_payloads(spark, path, fields)[0]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """security_id, date, open_raw, high_raw, low_raw, close_raw, volume; rows without a date or a close go."""
    rows = _payload(spark, path, HISTORY).select("security_id", F.try_to_date("date").alias("date"), *[F.col(c).alias(f"{c}_raw") for c in ("open", "high", "low", "close")], "volume")
    return rows.where("date is not null and close_raw is not null")


def read_actions(spark: SparkSession, dividends: str, splits: str) -> DataFrame:
    """security_id, date, action_type, action_value, action_ratio of both kinds of files; ratios that can't be read go."""
    day = F.try_to_date("date").alias("date")
    paid = _payload(spark, dividends, DIVIDENDS).select("security_id", day, F.lit("cash_dividend").alias("action_type"), F.col("value").alias("action_value"), F.lit(None).cast("double").alias("action_ratio"))
    ratio, kind = text.split_ratio(F.col("split"))
    cut = _payload(spark, splits, SPLITS).select("security_id", day, kind.alias("action_type"), F.lit(None).cast("double").alias("action_value"), ratio.alias("action_ratio"))
    return paid.unionByName(cut.where("action_ratio > 0")).where("date is not null")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """code, company_name, raw_type, currency, isin of an exchange's file, whose name is the exchange's code; the first row of a code counts."""
    rows = _payload(spark, path, ROSTER).select(F.col("security_id").alias("exchange_group"), *[text.clean(F.col(a)).alias(b) for a, b in (("Code", "code"), ("Name", "company_name"), ("Type", "raw_type"), ("Currency", "currency"), ("Isin", "isin"))], f"`{PLACE}`")
    return first_wins(rows.where("code <> ''"), ["exchange_group", "code"])


def write_summary(df: DataFrame, path: str) -> None:
    """Each row as one JSON object with its keys in order, at every level."""

    def ordered(c, kind):
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    df.select(*[ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_protocol(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Folds (fold_id, test_from, test_to) and the holdout (name, first, last) that a protocol file puts in place of the usual ones, as month ordinals."""
    month = lambda c: (F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int") - 1).cast("int")
    file = spark.read.schema("name string, insample_end string, oos_start string, oos_end string, rolling_origin_folds array<array<string>>").option("multiLine", True).json(path)
    each = file.select(F.posexplode("rolling_origin_folds").alias("k", "f"))
    folds = each.select((F.col("k") + 1).alias("fold_id"), month(F.col("f")[F.size("f") - 2]).alias("test_from"), month(F.col("f")[F.size("f") - 1]).alias("test_to"))
    return folds, file.select("name", month(F.col("oos_start")).alias("first"), month(F.col("oos_end")).alias("last"))


def locked_rows(panel: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """The one row of ``panel`` with each locked candidate's parameters; none, or several, is an error."""
    many = panel.groupBy(*keys).agg(F.count("*").alias("many "))
    wanted = locked.select(*keys).distinct().join(many, keys, "left")
    right = F.when(F.coalesce("many ", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a locked candidate must have one row")).cast("boolean"))
    return panel.join(wanted.where(right).select(*keys), keys)


def write_monthly(df: DataFrame, path: str, month: str) -> None:
    """Overwrites the months that ``df`` has and leaves the others: running a month again changes nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def flatten_positions(picks: DataFrame) -> DataFrame:
    """One row for each position of nested picks (role, holding_month, positions), with its place from 1."""
    rest = [c for c in picks.columns if c != "positions"]
    return picks.select(*rest, F.posexplode("positions").alias("k", "p")).select(*rest, (F.col("k") + 1).alias("position"), "p.*")
