"""A corpus pipeline: quality classifier, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, further columns of docs pass unchanged (a column n_lines or
n_dropped does not pass the line stage), texts are taken whole however long, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import line_dedup, packing, quality, similar, simhash
from loomstone.llm.common import crc_mod, documents, written

#: Not stated in SQL: the tests hold every stage against a plain version of it.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go.

    It learns from the labels of documents whose crc32(doc_id as text) mod 4 is not 2. Null and repeated ids are judged by their
    text like others; repeated rows stay or go together. Without any label every score is one half, so all documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model, _ = quality.learn(docs.select("doc_id", "text"), labels, train_on=lambda c: crc_mod(c, 4) != 2, every=False)
    return quality.keep_good(docs, model, threshold=0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay once, in the document with the smallest doc_id, and go
    everywhere else: of a text with ten copies one must be left for the next stage. n_chars follows the text.

    Rows with equal ids are treated alike, so of repeated rows all keep the line. A null id is never the smallest: lines that
    only such rows share go from all of them. A null text becomes the empty text."""
    out = line_dedup.dedup_lines(docs, min_docs=10, keep="first")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar shingles of five words (a Jaccard similarity of 0.8 or more, over any number of
    steps), the smallest doc_id stays. Pairs come by SimHash fingerprints with pivot distance tables, the alike ones whose fingerprints
    are further apart by their rare shingles, and all are verified on the whole sets.

    Texts without words are one group. Of repeated rows of the smallest id all stay; rows with a null id stay always."""
    groups = similar.similar_groups(docs.select("doc_id", "text"), words_each=5, similarity=0.8)
    return simhash.keep_one(docs, groups)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 tokens; no bin holds two pieces of one source or of equal texts.

    Null sources never conflict. Null ids, repeated ids and repeated rows are packed as rows of their own. Ties go by id,
    text and source."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_similar),
    ("best_fit_packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
