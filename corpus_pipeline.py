"""From documents to packed training sequences: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs are all rows that the stage before kept,
and its result is written as Parquet in the shared folder and read again as the next one's
docs, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontaminate, near_dedup, packing, substring_dedup, toxicity
from memloom.llm.queries import _public_tokenizer, table
from memloom.llm.shared import drop, materialize

#: No SQL: it can't express the toxicity model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go.

    Rows are judged one by one, by their text alone: equal texts fare alike, whatever their
    doc_id, null and repeated ones too. Null and empty texts have the intercept's score. An
    empty table stays empty; without labels nothing goes. Other columns pass through,
    whatever their names.
    """
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=toxicity.held_out_rows(0, 5))
    return toxicity.drop_toxic(docs, weights)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id stays.

    Rows that repeat a doc_id are one document: of those, one row stays, that with the least
    text (null first). Rows without a doc_id stay and count as no one's copy, and so do
    documents without words. An empty table stays empty. Other columns pass through.
    """
    return near_dedup.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document has are cut out of the text, and n_chars follows.

    A document left without words stays, empty; one that loses nothing keeps its text as it
    is, null too. Rows without a doc_id stay whole and count as no one's source. Of equal
    passages the one in the smallest doc_id stays. An empty table stays empty. Other columns
    pass through, whatever their names.
    """
    out = substring_dedup.replace_repeats(docs, window=20)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of 13 benchmark words go, however long they are.

    So do those of which a twentieth lies in shorter items. Rows are judged by their text
    alone, whatever their doc_id; null and empty texts stay. With an empty benchmark
    nothing goes. Other columns pass through.
    """
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences.

    Every row is a document of its own, null and repeated doc_ids too; a null or empty text
    is the end token alone. An empty table gives no rows. Other columns are left out.
    """
    return packing.pack(docs, _public_tokenizer("byte_bpe_50k.json"), kind="byte", end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
