"""The corpus pipeline: five stages, each an operator of ``tidelog.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows it
keeps, with the columns of ``docs`` (the last one returns batches of pieces). ``run`` applies them to
``documents``; between stages rows are written to the shared folder as Parquet and read again, and what the stage before wrote is deleted.

Near-dedup links texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Edge cases are those of the operators: null and empty texts fail the quality rules; repeated rows of a
document count as one group in near-dedup, of which the row with the smallest id stays (of several with that id, the
first by its text's hash); an empty table passes through; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common, mixing, packing, quality_rules, simhash, toxicity

#: Target shares of tokens by language. The total grows until the language most above its target stays
#: whole, so the stage repeats documents of scarce languages and drops no clean one.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return toxicity.remove_toxic(docs, common.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return simhash.keep_one_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The labelled rows are those that name their language; others get posteriors from their words alone.
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").groupBy("doc_id").agg(F.min("lang").alias("domain"))
    return mixing.mix(docs, known, TARGETS, grow=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(docs))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
#: Vote estimation, learned scores and the bucket search aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    start = common.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage{k}")
            common.release(spark, start, docs)  # what the stage read and wrote on its way
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
