"""A training-data pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its rows are written as Parquet
in the shared folder and read back as the next stage's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import documents, fresh, stored, tokenizer_file
from pulsegrid.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go."""
    from pulsegrid.llm.toxicity import THRESHOLD, ToxicTagger

    ship_package()
    score = fresh("_score", docs.columns)
    tagger = ToxicTagger.fit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return tagger.scores(docs, score).where(F.col(score) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one."""
    from pulsegrid.llm.line_dedup import dedup_lines

    ship_package()
    return dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays.

    Texts link whose SimHash fingerprints differ in 3 or fewer bits (as in op10), and texts whose five-word shingles have
    a similarity of 0.8, which differ in more bits as a rule. A group goes over links of both kinds.
    """
    from pulsegrid.llm.simhash import similar_components

    ship_package()
    lost = similar_components(docs, words=5, distance=3).where("doc_id <> component_id").select(F.col("doc_id").alias(fresh("_lost", docs.columns)))
    return docs.join(lost, docs["doc_id"] == lost[lost.columns[0]], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that sources meet their target weights."""
    from pulsegrid.llm.mixing import mixed_documents

    ship_package()
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, decoded again."""
    import public_tokenizers

    from pulsegrid.llm.byte_bpe import encode_decode, tokenizer_json

    ship_package()
    rows = encode_decode(docs.select("doc_id", "text"), tokenizer_json(tokenizer_file("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: A trained tagger, fingerprints and a tokenizer can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row for each row of the mix."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
