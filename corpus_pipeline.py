"""A corpus made ready for training: language ID, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchwright.llm import language_id, minhash_dedup, sentencepiece_backend, source_mixing
from matchwright.llm.common import numbered, stored, table, temp_name
from matchwright.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found, with ``lang`` as the network names it.

    Rejected is what has no language: null and empty texts, and texts without a letter.
    A low score rejects nothing, for short clean texts score low too. The network learns
    from the rows that are not held out; where none of them names a language all rows
    go. Repeated rows are judged each for itself; an empty table gives an empty one."""
    mark = temp_name(docs, "language_id")
    found = language_id.identify(docs).where(F.col(mark)["lang"] != "und")
    return found.withColumn("lang", F.col(mark)["lang"]).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, a row
    without an id only where none has one, and of rows that repeat that id the first.

    Near-duplicates share 0.8 or more of their five-word shingles. Texts without a word
    are near to nothing and stay, each row; an empty table gives an empty one."""
    rows = numbered(docs, "row")
    found = minhash_dedup.near_duplicates(rows, key="row", p=minhash_dedup.FOUR_FIFTHS).select(F.col("doc_id").alias("row_"), "component_id")
    ids = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place"))
    first = ids.join(found, F.col("row") == F.col("row_")).groupBy("component_id").agg(F.min("place").alias("place"))
    kept = first.select(F.col("place.row").alias("kept_row"))
    return rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order in which sources follow their weights: files in the
    order of their names, and the rows in each as they stand. Null sources are one
    source; null and repeated ids and texts stay; an empty table gives an empty one."""
    return source_mixing.in_order(source_mixing.mix(docs.select(*COLUMNS)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with what decoding them gives back, in the order
    of the mixture. Spark does not read files back in the order of their names, so
    ``position`` says each row's place: order by it wherever the result is read again.
    A null text has no ids; repeated rows are encoded each for itself; an empty table
    gives an empty one."""
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    placed = numbered(docs, "position").orderBy("position")
    return sentencepiece_backend.encode(placed, model, keep_ids=True, place="position")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: A trained network, MinHash and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
