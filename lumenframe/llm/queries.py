"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import blockmax, chroma, circulant, crf, lattice, linefreq, mixing, packing, smallworld, template, urltree, veccodes
from lumenframe.llm.secrets import scan_secrets
from lumenframe.llm.tables import bound_batches, settle

#: Environment variables that name other tokenizer files than those of the public_tokenizers package.
TOKENIZER_SETTING, VOCABULARY_SETTING = "LUMENFRAME_TOKENIZER", "LUMENFRAME_VOCABULARY"

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return os.environ.get(TOKENIZER_SETTING) or public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return os.environ.get(VOCABULARY_SETTING) or public_tokenizers.path("piece_bpe_32k.model")


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = settle(chroma.spoken_turns(_read(spark, sf_dir, "conversations")))
    return chroma.align(prints, F.col("conv_id") % chroma.QUERY_STEP == 0)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_read(spark, sf_dir, "documents"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(_read(spark, sf_dir, "pages"))


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(_read(spark, sf_dir, "documents"), percent=circulant.QUERY_PERCENT)


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.quality(_read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(_read(spark, sf_dir, "pages"))


def op9_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_scores(_read(spark, sf_dir, "documents"), lattice.read_vocabulary(vocabulary_path()))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_small_world_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallworld.nearest(_read(spark, sf_dir, "embeddings"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chroma_fingerprints, op2_source_mix, op3_url_templates, op4_circulant_minhash, op5_toxic_spans, op6_line_frequency, op7_secret_scan, op8_template_extraction, op9_subword_lattice, op10_best_fit_packing, op11_small_world_graphs, op12_block_max_search, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_circulant_minhash": circulant.oracle(), "op6_line_frequency": linefreq.oracle(), "op12_block_max_search": blockmax.oracle(), "op13_vector_codes": veccodes.oracle()}
