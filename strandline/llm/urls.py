"""URL rules, matched by hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join goes by.
SHORT = 8
#: Distinct lengths of rules' paths that are held as a literal; with more, all of a path's prefixes are looked up.
MOST_LENGTHS = 1000
#: A URL that more than one in so many pages has is dealt out in parts: there can't be more such URLs than this.
HOT = 1000


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table of rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule and verdict of each row.

    A rule (host, path, verdict) fits a URL if the URL's host is the rule's or a subdomain of it and
    the URL's path starts with the rule's. The longest rule (host and path) wins, then the one
    with the longer host, then ``allow`` before ``block``. Without a rule the verdict is ``default``.

    Each distinct (host, path) is expanded into its host's suffixes times its path's prefixes, of the
    lengths that rules have; SHA-256 digests of the expressions are joined to the rules' by their first
    ``SHORT`` digits and confirmed in full. Distinct pairs keep a hot URL from being expanded
    again and again. Rules may be of any number: Spark broadcasts them only below its own threshold, and else
    shuffles both sides. When verdicts go back to pages, a pair that more than one page in ``HOT`` has (so at most ``HOT`` pairs,
    which are broadcast) is split into parts. Only built-in functions are used.

    A null URL or one without ``://`` has an empty host and path, and no rule. A null id stays null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not looked at.
    """
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(
            F.sha2(F.concat("host", "path"), 256).alias("r_digest"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_chars"),
            F.length("path").alias("path_chars"),
            "verdict",
        )
    )
    lengths = [r[0] for r in rules.select("path_chars").distinct().limit(MOST_LENGTHS + 1).collect()]

    judged = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    if len(lengths) > MOST_LENGTHS:
        prefix_lengths = F.sequence(F.lit(0), F.length("path"))
    else:
        prefix_lengths = F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")
    counts = judged.groupBy("host", "path").agg(F.count("*").alias("pages"))
    often = max(1, pages.count() // HOT)
    hot = F.broadcast(counts.where(F.col("pages") > often).select("host", "path", F.ceil(F.col("pages") / often).cast("int").alias("parts")))
    expressions = (
        counts.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.filter(prefix_lengths, lambda n: n <= F.length("path"))).alias("n"))
        .select("host", "path", F.sha2(F.concat("suffix", F.expr("substring(path, 1, n)")), 256).alias("digest"), F.length("suffix").alias("s_chars"), "n")
    )
    found = (
        expressions.join(rules, F.substring("digest", 1, SHORT) == F.substring("r_digest", 1, SHORT))
        .where((F.col("digest") == F.col("r_digest")) & (F.col("s_chars") == F.col("host_chars")) & (F.col("n") == F.col("path_chars")))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule", "verdict"),
                F.struct(F.col("host_chars") + F.col("path_chars"), "host_chars", F.when(F.col("verdict") == "allow", 1).otherwise(0), "verdict"),
            ).alias("best")
        )
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = judged.join(hot, ["host", "path"], "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    verdicts = found.join(hot, ["host", "path"], "left").select("host", "path", "best", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(verdicts, ["host", "path", "part"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
