"""Documents made ready for training: language, near duplicates, test items, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import contamination, language, near, pii, tokens
from strandline.llm.queries import BPE, PIECES
from strandline.llm.storage import saved

#: Documents whose language is less likely than this, or that have no letters, go.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; lang becomes the one found.

    Documents go that have no letter (null and empty texts too), that two learned languages fit alike, or that look like text of no learned
    language (``language.unlearned_rates``): other languages, code, random letters. Each row is judged by its own text, so a null or
    repeated doc_id changes nothing and repeated rows stay or go together; an empty table, or one without labels, gives an empty one.
    """
    found = language.identify_languages(docs, PIECES, keep_row=True, tell_learned=True)
    its = found[found.columns[-1]]
    sure = found.where(its.learned & (its.score >= LEAST_LANGUAGE_SCORE))
    return sure.select(*[its.lang_pred.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its least doc_id, or of the least text hash where that id stands on several texts.

    A row with a null doc_id takes part by a number made from its text, above 2^62, so that it goes where any like text has an id, and one of
    such rows stays where none has. Of rows equal in doc_id and text one stays, whichever comes first. Rows without a word (null and empty texts
    too) are like nothing and stay. An empty table gives an empty one. Only identifiers and hashes are grouped; texts are shuffled only of rows that are repeated.
    """
    fresh = [f"{name} {len(max(docs.columns, key=len))}" for name in ("id", "key")]
    ident, key = (F.col(f"`{c}`") for c in fresh)
    text = F.col("text").cast("string")
    made = F.shiftleft(F.lit(1).cast("long"), 62) + F.shiftrightunsigned(F.xxhash64(text, F.lit("null id")), 3)
    rows = docs.withColumns({fresh[0]: F.coalesce(F.col("doc_id").cast("long"), made), fresh[1]: F.xxhash64(text)})
    found = near.near_duplicates(rows.select(ident.alias("doc_id"), "text"), keep_key=True).where("n_shingles > 0")
    groups = found.groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n"))
    least = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    stays = F.struct("doc_id", "text_key") == F.col("least")
    judged = saved(groups.join(least, "component_id").select(F.col("doc_id").alias(fresh[0]), F.col("text_key").alias(fresh[1]), "n", stays.alias("stays")), "judged")
    kept = rows.join(judged.where("not stays").drop("n", "stays"), fresh, "left_anti")
    repeated = judged.where("stays and n > 1").drop("n", "stays")
    if not repeated.isEmpty():
        once = kept.join(repeated, fresh, "left_semi").dropDuplicates(fresh)
        kept = kept.join(repeated, fresh, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, each judged by its own text, whatever its doc_id."""
    return contamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind, and n_chars of the new text."""
    found = pii.personal_data(docs, redact=True, keep_row=True)
    text = F.when(F.col("text").isNotNull(), found[found.columns[-1]].redacted_text)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens and the digests of their identifiers and of the text decoded from these."""
    found = tokens.encode_documents(docs, BPE, keep_ids=False, keep_row=True)
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    own = [c for c in docs.columns if c not in made]
    return found.select(*own, *[found[found.columns[-1]][c].alias(c) for c in made])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", bpe),
]
#: Learned models and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
