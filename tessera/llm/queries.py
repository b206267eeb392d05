"""The operators' queries over the driver's tables, with production parameters, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import audit, decontaminate, language, packing, pages, phrases, pieces, quality, rules, simhash, substrings, tokens, toxicity
from tessera.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op1(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op3(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.transduce(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op6(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.op7(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op10(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op11(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op12(table(spark, sf_dir, "documents"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_language, op2_quality, op3_rules, op4_pieces, op5_simhash, op6_tokens, op7_pages, op8_toxicity, op9_decontaminate, op10_substrings, op11_packing, op12_phrases, op13_audit, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontaminate": decontaminate.ORACLE, "op10_substrings": substrings.ORACLE, "op12_phrases": phrases.ORACLE, "op13_audit": audit.ORACLE}
