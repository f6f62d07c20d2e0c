"""The queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import ann, codes, linededup, media, mixing, phrases, piece_bpe, pii, quality, secrets, sharding, simhash, toxicity
from logweft.llm.common import table


def piece_model() -> str:
    """The public tokenizer's file, on whichever machine it is asked for."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op8_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_skip_chain, op2_ann_ivfpq, op3_mix_sources, op4_piece_bpe, op5_hypergeometric_shards, op6_simhash_components,
        op7_secret_links, op8_media_sequences, op9_quality_crf, op10_toxic_segments, op11_phrase_automata, op12_line_runs, op13_yinyang_codes, pipeline,
    )
}

ORACLE_SQL = {
    "op3_mix_sources": mixing.oracle_sql(), "op7_secret_links": secrets.oracle_sql(), "op11_phrase_automata": phrases.oracle_sql(),
    "op12_line_runs": linededup.oracle_sql(), "op13_yinyang_codes": codes.oracle_sql(),
}
