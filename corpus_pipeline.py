"""A corpus pipeline over ``documents``: from raw texts to mixed, encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet in the shared folder and gives what it reads back to the next one.
All stages but the last return the columns of documents. When a stage begins,
what it reads is written: it deletes whatever else the stages before it stored.
Null and empty texts are documents without words: no stage but the mix, which
takes no copy of them, removes them. Every row is a document of its own, also
where its doc_id is null or repeated. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from voxara.llm import jaccard, lines, mixing, toxicity
from voxara.llm.common import drop_unread, load, open_folders, stored
from voxara.llm.pieces import encode_documents, with_digests
from voxara.llm.queries import TOKENIZERS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the stages so far have stored.
_made: list[str] = []


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(docs, _made)
        before = open_folders()
        out = function(spark, docs, sf_dir)
        _made[:] = [p for p in open_folders() if p in _made or p not in before]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon predicts toxic go."""
    return toxicity.remove_toxic(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal lines the first stays; documents left without words go."""
    return lines.dedup_lines(docs)


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked at 0.8 or more over five words the one with the smallest doc_id stays."""
    return jaccard.dedup_documents(docs, num=80, den=100, words=5)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digests of ids and decoded text."""
    return with_digests(encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Merge encoding is no SQL. Tests hold each operator against brute force, and the stages to their contracts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole of documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if name != STAGES[-1][0]:  # what is returned stays
            _made.append(docs.stored_at)
    return docs
