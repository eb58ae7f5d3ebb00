"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of the
documents table. Every stage works on all that the stage before kept:

1. quality rules: documents that the rules reject go;
2. line dedup: lines that are the same, or nearly, as an earlier line go from the texts;
3. SimHash near-dedup: one document of each component stays;
4. mixing: documents are taken towards their sources' targets, some not at all and some twice;
5. packing: sequences of at most 2048 tokens along the curve.

Defined cases, for every stage: nulls may stand in any column, an empty table gives an empty result, and columns
beyond those of documents, whatever their names, pass through unchanged (up to the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import line_dedup, mixing, packing, quality, simhash
from chronolith.llm.common import Workspace, passing_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    A null, empty or very short text fails them; rows that repeat are judged one by one, and alike; a null
    language is judged with the other unknown ones.
    """
    return quality.passing(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that an earlier document or line has, exactly or nearly.

    A null text stays null, an empty one empty; a document whose lines all go keeps its row; rows that repeat id
    and text are one document and come out alike, with all their lines; null ids come last. n_chars follows the
    text where there is one.
    """
    out = line_dedup.kept_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id.

    Null and empty texts are copies of each other; of rows that repeat the smallest id one stays; rows with a
    null id stay only where the component has no other, and then one of them.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    Texts without a word are not taken; null sources are one source; rows that repeat id and text share what they
    are taken for, rounded up; null ids are documents like others.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, one row a piece.

    A null or empty text is its end mark alone; rows that repeat are packed each; ids may be null.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack sequences", pack),
]

#: SQL cannot express tokenizing or signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next.

    What a stage wrote on its way goes when its result is written.
    """
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with passing_tables():
            docs = ws.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
