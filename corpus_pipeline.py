"""From raw documents to a token mix: classify, clean, deduplicate, mix, and encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet and read again
before the next. All but the last return the columns of ``documents``. Whole texts are read, however long; an empty table
goes through as one. Ids should be unique and not NULL; what happens otherwise is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import minhash, mixing, pieces, quality, toxicity
from linkloom.llm.common import saved, table
from linkloom.llm.queries import public_model


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go.

    NULL and empty texts are judged as texts without words. Rows that repeat an id or a text are judged each for itself, alike; rows
    with a NULL id are judged too. Scores at the threshold stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go; it is learned from what came in here.

    NULL and empty texts hold no term and stay. Repeated rows and NULL ids are judged as any others; scores at the cut go.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    NULL, empty and blank texts are near nothing and stay. Of rows that repeat an id one stays; rows with a NULL id stay all.
    """
    return minhash.keep_first(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so some twice and some not at all.

    NULL and empty texts have size 0 and are taken along with whole passes over their source; a NULL source is one source, the
    last. Which of several documents of one length are taken a hash of the id decides, so reruns agree; rows that repeat an id, or
    whose id is NULL, share its number of copies.
    """
    return mixing.repeat(docs, mixing.five_two_one)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32 bits each, little-endian), and digests of them and of the text they stand for:
    (doc_id, n_tokens, ids_sha256, decoded_sha256, ids). NULL and empty texts have the begin and end ids alone; every row
    has one, whatever its id."""
    out = pieces.encode_decode(docs, pieces.load(public_model()))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids",
    )


STAGES = [("quality", good), ("toxicity", harmless), ("near copies", distinct), ("mixing", mixed), ("encoding", encoded)]

#: Trained models and token merges are beyond SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
