"""Corpus preparation from raw documents to packed training sequences, stage by stage.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables.
All but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import line_dedup, mixing, packing, quality, shingle_sets, simhash
from farpoint.session import materialize

# Near copies: sets of five-word shingles with a Jaccard similarity of at least 0.8 (``shingle_sets``). The rule by 128 bits
# of which 0.8 are equal no longer decides; its numbers stay for comparison.
SHINGLE, PRINT_WORDS, SEGMENT_BITS = 5, 2, 16
MOST_BITS = 128 - -(-128 * 8 // 10)

# SQL has neither the fitted scorer nor the hashes of the fingerprints and the mix.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, keeps."""
    judged = quality.score(docs, quality.fit(docs), name="_quality")
    return judged.where(F.col("_quality") >= 0.5).select(*_columns(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of smaller id holds; a document may become empty, but stays."""
    kept = line_dedup.dedup_lines(docs)
    length = F.char_length("text").cast("bigint")
    return kept.select(*[(length if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies."""
    classes = shingle_sets.jaccard_classes(docs, width=SHINGLE)
    return simhash.keep_first(docs, classes)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = mixing.mix_sources(rows, carry=["_row"]).where("_copies > 0").select("_row", "_copies")
    return rows.join(copies, "_row").select(*_columns(docs), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
