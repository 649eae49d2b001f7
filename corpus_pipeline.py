"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the factorization machine rejects go;
2. near duplicates: of each group of the n-gram Jaccard join (five words, 0.8) one row, of least id, stays;
3. decontamination: documents with any window of a benchmark item go;
4. personal data: validated values are replaced by format-preserving pseudonyms;
5. packing: what stays is packed into sequences, one row a piece.

Every stage but the last returns the columns of its input, whatever others there are beside
``doc_id`` and ``text``; ``n_chars``, where there is one, follows a text that is changed.
Nulls, empty texts, repeated rows and empty tables are handled as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, kernels, ngram_join, packing, pii, toxicity

#: The key of the demonstration run; a real run sets its own.
KEY = "demonstration key"
#: Before columns of the input that are named like an operator's result.
PREFIX = "_own_"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half. The model is fitted on the labelled documents among this stage's input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), hold_out=False)
    own = {c: f"{PREFIX}{c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = toxicity.score(docs.withColumnsRenamed(own), model).where("predicted = 0")
    return scored.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="document")


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; ``n_chars`` follows the text."""
    count = kernels.free_name(docs.columns, "n_values")
    done = pii.pseudonymize(docs, key=KEY, count_col=count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("personal data", personal_data_replaced),
    ("packing", packed),
]

#: A learned score is not SQL's to give; the stages are held against brute-force versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kernels.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
