"""Corpus pipeline over `documents`: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage reads all rows that the one before kept, from Parquet, and its decisions take effect. All but the last return
the columns of `documents`, and of whatever else the table holds. Null and empty texts are clean: they pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, neardup, privacy, toxicity
from pulsegrid.llm.queries import bound_batches, packed, table, toxicity_model
from pulsegrid.session import ship_package, stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below the operator's threshold. Repeated rows stay or go together, null and empty
    texts are scored as texts without a word, and an empty table stays empty."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    rated = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, ["row"])
    return rated.where(F.col("score") < toxicity.Settings.threshold).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id. Rows that share a doc_id but not a text are documents of
    their own. Rows without doc_id or without words stay; an empty table stays empty."""
    return neardup.without_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage within the allowed edit distance of a benchmark item. Repeated rows stay or go together,
    null and empty texts stay, and an empty table stays empty."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms masked in the text; n_chars follows the new text."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    found = privacy.sanitise(docs.select("doc_id", "text", rest.alias("rest")), ["rest"])
    now = {"text": F.col("masked"), "n_chars": F.when(F.col("masked").isNull(), F.col("rest.n_chars")).otherwise(F.length("masked")).cast("long")}
    return found.select([now.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences. Repeated rows are packed each, null and empty texts as their end
    token alone, and an empty table gives no piece."""
    return packed(docs)


def _stage(function):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return function(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_benchmark_passages)),
    ("personal_data", _stage(mask_personal_data)),
    ("packing", _stage(pack)),
]

#: SQL cannot express trained scores, token ids or packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of `sf_dir`; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
