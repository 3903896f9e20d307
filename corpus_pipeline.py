"""A corpus from raw documents: rules, exact and near copies, a mix of sources, packing.

Every stage takes the documents that its predecessor kept and, but for the last, returns
documents with the same columns. Rows may have NULLs in any column, repeat an id or be
equal; further columns are carried along, whatever their names.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.exact_dedup import exact_dedup
from tablegauge.llm.mixing import mix_sources
from tablegauge.llm.near_dedup import near_dedup
from tablegauge.llm.packing import pack, pieces
from tablegauge.llm.quality_rules import FULL, apply_policy, ledger
from tablegauge.llm.words import KEYS, folded, one_row_each, pick_rows, row_keys, stored, text_key, whole

#: Sketches, packing and the pseudo-random order of sources are not expressed in SQL.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return whole(apply_policy(ledger(folded(docs)), FULL).filter("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the document with the smallest id."""
    keyed = docs.select("doc_id", "text", text_key("text").alias("text_key"))
    return pick_rows(docs, exact_dedup(keyed, carry=("text_key",)).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return pick_rows(docs, near_dedup(docs).filter("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each pass that takes words of them.

    A document at which its source reaches the target is taken whole if that is at least
    as near to the target as leaving it out, and else not in that pass.
    """
    keyed = docs.select("doc_id", "text", "source", text_key("text").alias("text_key"))
    takes = mix_sources(keyed, carry=("text_key",)).select(*row_keys(), "size", F.explode("passes").alias("__take"))
    near = takes.filter(F.col("__take.words") * 2 >= F.col("size"))
    rows = one_row_each(folded(docs)).join(near.drop("size"), KEYS)
    ordered = rows.orderBy("__take.time", "__id", "__take.pass")
    return ordered.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 1024."""
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources", mix),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
