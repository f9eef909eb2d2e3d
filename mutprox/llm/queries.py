"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mutprox.llm import chat, codes, fim, langid, lines, packing, pieces, quality, shards, simhash, suffix, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; only queries that use one need the folder."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; null and wordless texts, null ids and repeats as in :func:`simhash.simhash_components`."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; nulls, ties and repeats as in :func:`suffix.repeat_digest`."""
    return suffix.repeat_digest(table(spark, sf_dir, "documents"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; see :func:`pieces.piece_digest`."""
    return pieces.piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece of a document; nulls, repeats and empty tables as in :func:`packing.pack`."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; see :func:`langid.identify`."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a segment of a maximal conversation; see :func:`chat.format_chats`."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; nulls and repeats as in :func:`quality.verdicts`."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


@query
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy keeps out, alone and at all, from the stored bits."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page; nulls and repeats as in :func:`lines.page_lines`."""
    return lines.page_lines(table(spark, sf_dir, "pages"))


ORACLE_SQL |= {"op1_chat_format": chat.ORACLE, "op2_quality_rules": quality.ORACLE, "op5_line_dedup": lines.ORACLE}
ORACLE_SQL["quality_ablations"] = quality.ABLATIONS


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector; broken vectors, null labels and repeats as in :func:`vectors.near_vectors`."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page of the drill; see :func:`warc.drill`."""
    return warc.drill(table(spark, sf_dir, "pages"))


ORACLE_SQL |= {"op4_embedding_dedup": vectors.ORACLE, "op8_warc_audit": warc.ORACLE}


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector without null or non-finite components; see :func:`codes.code_digest`."""
    return codes.code_digest(table(spark, sf_dir, "embeddings"))


@query
def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; see :func:`shards.shard_table`."""
    return shards.shard_table(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; see :func:`fim.transform_digest`."""
    return fim.transform_digest(table(spark, sf_dir, "documents"))


ORACLE_SQL |= {"op11_vector_codes": codes.ORACLE, "op12_hilbert_shards": shards.ORACLE, "op13_fill_in_middle": fim.ORACLE}
