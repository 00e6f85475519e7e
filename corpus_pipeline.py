"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes all that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontaminate, jaccard, packing, repeats, toxicity
from ballast.llm.common import Shelf, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network fitted to the labels scores under a half.

    Null and wordless texts stay unless nearly all labels are toxic; without
    labels of both classes the majority decides for all.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of 5-word shingles the one of smallest id.

    Texts without words and rows without an id stay. Rows of one id are one
    document and stay or go together.
    """
    found = jaccard.near_duplicates(docs)
    return docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text less all strings of 200 bytes that occur elsewhere too; n_chars is counted anew.

    A character that such a string covers in part stays. Null texts stay null,
    and a document that consists of repeats stays with an empty text.
    """
    plain = docs.withColumnsRenamed({c: f"own_{c}" for c in ("spans", "kept")})
    found = repeats.without_repeats(plain, characters=True)
    hit = F.size("spans") > 0
    text = F.when(hit, F.col("kept").cast("string")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(hit, F.char_length(text)).otherwise(F.col("n_chars"))}
    return found.select([new.get(c, F.col(f"own_{c}" if c in ("spans", "kept") else c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its 5-word shingles. Rows without an id or text stay."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]

#: Scores of a trained network and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, shelf.put(stage(spark, docs, sf_dir))
        shelf.drop(before)
    return docs
