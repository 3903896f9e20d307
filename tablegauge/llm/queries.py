"""Registered queries of this subpackage: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import bpe, conversations, lexical, license_scan, quality_model, toxicity
from tablegauge.llm.exact_dedup import exact_dedup
from tablegauge.llm.mixing import by_first_due, mix_sources
from tablegauge.llm.near_dedup import near_dedup
from tablegauge.llm.packing import pack, pieces
from tablegauge.llm.quality_rules import BASE, FULL, apply_policy, ledger
from tablegauge.llm.suffix_dedup import suffix_dedup
from tablegauge.llm.warc import read_warc, write_warc
from tablegauge.llm.words import squeezed_sql, stored
from tablegauge.sources.storage import run_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = apply_policy(ledger(_table(spark, folder, "documents").select("doc_id", "text")), FULL)
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "fail_bits", "policy_version",
    )


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(
        "doc_id", "text", F.sha2(F.expr(squeezed_sql("text")), 256).alias("text_sha256")
    )
    found = exact_dedup(docs, carry=("text_sha256",))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(_table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    mix = by_first_due(mix_sources(_table(spark, folder, "documents").select("doc_id", "text", "source")))
    first = F.try_element_at("passes", F.lit(1))
    return mix.select("doc_id", "size", "source_size", "target", "taken", first["time"].alias("first_due"))


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(pieces(_table(spark, folder, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark, "archives")
    write_warc(_table(spark, folder, "pages"), path)
    return read_warc(spark, path).select(
        F.expr("nullif(id, '')").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.expr("nullif(refers_to, '')").cast("long").alias("refers_to"),
        "intact",
    )


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    found = quality_model.score(docs, quality_model.fit(docs, labels))
    return found.withColumn("predicted", (F.col("score") >= quality_model.THRESHOLD).cast("int"))


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.fit(docs))
    sure = "transform(filter(notices, x -> x.confirmed), x -> struct(x.probability, -x.paragraph as place, x.similarity))"
    best = F.expr(f"array_max({sure})")
    return found.select(
        "doc_id",
        F.size("notices").alias("n_candidates"),
        F.expr("size(filter(notices, x -> x.confirmed))").alias("n_confirmed"),
        F.expr("array_join(array_sort(array_distinct(filter(notices, x -> x.confirmed).family)), ', ')").alias("families"),
        (-best["place"]).alias("paragraph"),
        best["probability"].alias("probability"),
        best["similarity"].alias("similarity"),
    )


def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(conversations.damaged(_table(spark, folder, "conversations")), "damaged")
    repairs = stored(conversations.repair(rows), "repairs")
    digests = conversations.repaired_digests(rows, repairs).withColumnRenamed("conv_id", "__conv")
    found = repairs.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def encoded_texts(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(_table(spark, folder, "documents").select("doc_id", "text"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    index = stored(lexical.build_index(_table(spark, folder, "documents")), "index")
    return lexical.search(index, _table(spark, folder, "benchmark"), 50)


QUERIES = {
    "op1_license_scan": licences,
    "op2_best_fit_packing": packed_pieces,
    "op3_warc": archived_pages,
    "op4_mix_sources": mixed_sources,
    "op5_quality_rules": quality_rules,
    "op6_quality_classifier": quality_scores,
    "op7_suffix_dedup": repeated_strings,
    "op8_toxicity": toxicity_scores,
    "op9_exact_dedup": exact_copies,
    "op10_near_dedup": near_copies,
    "op11_conversation_repair": repaired_conversations,
    "op12_bpe": encoded_texts,
    "op13_lexical_search": ranked_documents,
}
