"""From raw documents to token ids: language, repeated lines, near duplicates, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import language, line_dedup, mixing, near_dedup, sentencepieces
from monthloom.llm.common import documents
from monthloom.sources.store import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language of the training labels (no text, no letter) go."""
    named = language.identify(docs, tuple(docs.columns), ("_held_out", "_lang_pred", "_score"))
    return named.where(F.col("_lang_pred") != language.UNKNOWN).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep their own lines; of a line in many documents one document keeps it."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group stays; rows sharing an id stay or go together."""
    gone = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: words taken over its size, rounded by a seeded draw."""
    draw = mixing.seeded(F.lit("copies"), F.col("doc_id").cast("string")) / float(1 << 60)
    taken = (mixing.mix_sources(docs)
             .withColumn("copies", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + draw).cast("int"))
             .groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.min("copies").alias("_copies"))
             .where("_copies > 0"))
    # a text taken at all has words, so it is not null
    return (docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.md5(docs["text"]) == F.col("_md5")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and how many."""
    return (sentencepieces.encode(docs.select("doc_id", "source", "text"))
            .select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [
    ("language", known_language),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mixed_sources),
    ("encoding", token_ids),
]

#: Language identification and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
