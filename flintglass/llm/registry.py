"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, conversation_trie, decontaminate, dual_tree, html_tree, jaccard_join, lang_hd, license_rules, line_crf, merkle_query, packing, pii_boost, secret_cnn
from .textops import table


def default_tokenizer() -> str:
    """Path of the public vocabulary file; pass another path to packing.pack_documents to change it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    """Path of the public byte-level vocabulary file; bpe_tree.encode takes any other of that kind."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score_documents(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_query.query(table(spark, sf_dir, "pages"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.report(table(spark, sf_dir, "documents"))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op5_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    prototypes = lang_hd.learn(docs.filter(~held).select("lang", "text"))
    found = lang_hd.predict(docs, prototypes)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op7_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_tree.extract_pages(pages, html_tree.fit(pages))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_cnn.report(docs, secret_cnn.fit(docs))


def op11_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_tree.encode(table(spark, sf_dir, "documents"), byte_tokenizer(), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_line_crf, op2_merkle_fixity, op3_pii_boosting, op4_license_rules, op5_language_hd, op6_bin_completion, op7_html_tree, op8_jaccard_join, op9_decontamination, op10_secret_cnn, op11_segment_bpe, op12_conversation_trie, op13_dual_tree_search)}
ORACLE_SQL = {"op2_merkle_fixity": merkle_query.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_dual_tree_search": dual_tree.SQL}
