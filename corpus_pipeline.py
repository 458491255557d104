"""From raw documents to packed training sequences, in stages that each hand a table to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueloom.checkpoints import freeze
from cueloom.llm import mixing, packing, partenum, quality_bayes, secrets
from cueloom.llm.queries import read


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier keeps, with all their columns.

    A document's own label decides where it has one. Null and empty texts have evidence like any other; rows that repeat
    a doc_id are judged alike; an empty table stays empty; without labels every document stays.
    """
    return quality_bayes.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all its columns.

    Null, empty and wordless texts are copies of nothing and all stay. Of equal doc_ids each row is judged by its own
    text; rows without a doc_id give way to each other only. An empty table stays empty.
    """
    return partenum.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that few owners hold replaced in their texts; n_chars follows the text.

    Null and empty texts stay as they are, repeated rows are masked alike, a null source is an owner of its own, and
    spans that overlap are masked as one.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes, one row per document and round, with the columns of documents.

    Texts without words are never taken. A null source is the last source; repeated rows are documents of their own;
    equal quotients go to the first source by name; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences.

    A null or empty text is one piece of one token, repeated rows are pieces of their own, and no row is left out.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_bad_quality),
    ("near_copies", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Packing and classification cannot be said in SQL; tests/llm compares run(), and each stage's table, with plain versions on a small fixture.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
