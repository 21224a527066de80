"""The queries of this package by name, each a thin view of its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import id_shards, impact_search, licence_digests, merkle_manifest, oracles, phrase_graph, piece_bpe, quality_rules, simhash_bk, site_style, source_mix, token_counts, toxicity, warc_revisits
from pagemill.llm.common import read, shared_folder


#: Vocabulary files; a cluster names its own place for them.
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
CONTEXT_TOKENS = 1024


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary(PIECES), F.col("doc_id"))
    return coded.withColumnRenamed("carried_0", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary(BYTES), F.col("doc_id"), limit=CONTEXT_TOKENS)
    return counted.withColumnRenamed("carried_0", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(read(spark, sf_dir, "documents"), F.col("doc_id"))
    return scored.select(F.col("carried_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.classes(read(spark, sf_dir, "documents"), F.col("doc_id"))
    return found.select(F.col("carried_0").alias("doc_id"), simhash_bk.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op6_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_style.extract(read(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"))
    named = texts.withColumnsRenamed({"carried_0": "page_id", "carried_1": "url"})
    return named.withColumn("n_chars", F.length("text").cast("long"))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_digests.scan(read(spark, sf_dir, "documents"), F.col("doc_id"))
    return found.select(F.col("carried_0").alias("doc_id"), "digest", "licence_id", F.array_join("notices", ",").alias("notices"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(read(spark, sf_dir, "documents"), F.col("doc_id"))
    return mixed.select(F.col("carried_0").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisits.parsed(warc_revisits.captures(read(spark, sf_dir, "pages")))
    return warc_revisits.resolve(records).withColumn("headers", warc_revisits.header_text(F.col("headers")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    told = toxicity.scored(docs, model, F.col("doc_id")).withColumnRenamed("carried_0", "doc_id")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether it still verifies after the line ends of every other one are deleted."""
    docs = read(spark, sf_dir, "documents")
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    harmed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proven = merkle_manifest.manifest(docs, merkle_manifest.leaf_digest(*told, F.col("text")), F.col("doc_id"), merkle_manifest.leaf_digest(*told, harmed))
    sides = F.col("lefts"), F.col("rights")
    checked = proven.select(F.col("carried_0").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest(*sides).alias("proof_sha256"), merkle_manifest.folded(F.col("carried_1"), *sides).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(phrase_graph.graph(read(spark, sf_dir, "documents")))


def op13_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids, and read back: places by the index from the documents' keys, digests from the payloads."""
    docs = read(spark, sf_dir, "documents")
    files = id_shards.write(docs, vocabulary(BYTES), shared_folder(spark, "ids"))
    found = id_shards.lookup(files, id_shards.key_list(docs))
    told = found.join(id_shards.digests(files), ["shard", "segment", "offset"])
    return told.select("doc_id", "start", F.col("count").alias("n_tokens"), "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
