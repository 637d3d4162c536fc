"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicates, repeated passages, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerine.llm import langid, linededup, minhash, packing, suffix
from ledgerine.llm.common import written
from ledgerine.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language is recognised or the best one holds less than this share of the likelihood.
LEAST_SCORE = 0.5
#: Or if its best language needs more bits a byte than this. Bytes take 8 without any model; a byte that a language never has costs it the escapes besides,
#: so text in no learned language needs 12 and more, while documents of sf0.1 need 2 at the median, and a short one that is half a key at most 9.
MOST_BITS = 10.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing label is filled in. Text in no learned language goes, as even its best one is at a loss.

    If no row has both a text and a label, nothing can be learned: documents with a letter stay, their label null.
    """
    model = langid.fit(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    known = (F.col("score") >= LEAST_SCORE) & (F.col("bits") <= MOST_BITS * F.octet_length("text"))
    found = langid.predict(docs, model).where((F.col("lang_pred") != "und") & known)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that five documents share stay in one."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.one_of_each(docs, shingle=5, percent=80).select(COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes and more that occur twice."""
    out = suffix.drop_repeats(docs, as_text=True).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary pieces with their token ids."""
    return packing.pack_binary(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("language ID", keep_languages), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_duplicates), ("suffix-array dedup", drop_passages), ("packing", pack)]

#: SQL can express neither the byte model nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
