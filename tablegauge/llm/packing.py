"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Every task packs its share of the pieces by decreasing best fit. Bins that are nearly
full are done; the others become items of the next round, in fewer tasks, where they are
merged by best fit again. Only (item, size) moves, never tokens.
"""

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import stored

CAPACITY = 1024
END = 2
#: A bin is done when so many tokens or fewer are free.
SLACK = 4
#: Items of one task.
ITEMS = 16_000
#: Rounds end when one leaves more than this share of its items as bins.
STALLED = 0.98
#: Name of the vocabulary among the public tokenizer files.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Name of the file with its added tokens.
ADDED = "byte_bpe_50k.json"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY, added: str = ADDED):
    """The byte-level BPE of the vocabulary file, which holds the ranks of `byte_bpe_50k.json`.

    Both give the same ids (a test compares them); this one encodes about three times
    as fast. Strings of special tokens in a text become the ids that the other file adds.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(public_tokenizers.path(added), encoding="utf-8") as file:
            special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        _encoders[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _encoders[vocabulary]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of `n` ids begin: only the first may be shorter than the capacity."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def _pieces(vocabulary: str, capacity: int, end: int, with_ids: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            source, rows, ids = [], [], []
            for i, text in enumerate(batch.column("text")):
                own = np.append(encode(text.as_py() or "", allowed_special="all"), end).astype("<u4")
                starts = cut(len(own), capacity)
                for k, (start, stop) in enumerate(zip(starts, [*starts[1:], len(own)])):
                    source.append(i)
                    rows.append((k, start, stop - start, zlib.crc32(own[start:stop])))
                    if with_ids:
                        ids.append(own[start:stop].astype(np.int32))
            table = np.array(rows, np.int64).reshape(-1, 4)
            columns = [
                batch.column("id").take(pa.array(source, pa.int64())),
                pa.array(table[:, 0].astype(np.int32)),
                *[pa.array(table[:, k]) for k in (1, 2, 3)],
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every row: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A row's ids are those of its whole text (NULL is empty) and `end`. Rows that repeat
    an id are separate. An empty table gives no pieces.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = given.mapInArrow(_pieces(vocabulary, capacity, end, with_ids), schema)
    return found.withColumnRenamed("id", id_col)


def best_fit(items: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decreasing best fit: for each item its bin (named by the bin's first item) and offset; and the order used.

    Bins are kept by free space, with a bit set for each space some bin has.
    """
    order = np.lexsort((items, -sizes))
    bins, offsets = np.empty(len(items), items.dtype), np.empty(len(items), np.int64)
    by_space: list[list] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for at in order.tolist():
        size = int(sizes[at])
        fitting = spaces >> size
        if fitting:
            space = (fitting & -fitting).bit_length() - 1 + size
            name = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, name = capacity, items[at]
        bins[at], offsets[at] = name, capacity - space
        left = space - size
        if left:
            by_space[left].append(name)
            spaces |= 1 << left
    return bins, offsets, order


def _packer(capacity: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        items, sizes = (np.concatenate([b.column(c).to_numpy() for b in given]) for c in ("item", "size"))
        bins, offsets, _ = best_fit(items, sizes, capacity)
        names, at = np.unique(bins, return_inverse=True)
        fill = np.bincount(at, weights=sizes, minlength=len(names)).astype(np.int64)[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (items, bins, offsets, fill)], names=["item", "bin", "at", "fill"])

    return work


def pack(parts: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `parts` with `sequence_id` and `offset`; no sequence exceeds `capacity`.

    Rows need not be distinct. Lengths must lie between 1 and the capacity.
    """
    ship(parts.sparkSession)
    rows = stored(parts.withColumn("__item", F.monotonically_increasing_id()), "parts")
    items = rows.select(F.col("__item").alias("item"), F.col(length).cast("long").alias("size"))
    placed = items.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("size") < capacity - SLACK)
    count, step = left.count(), 0
    while count > 1:
        dealt = left.repartition(-(-count // ITEMS), F.xxhash64("item", F.lit(step)))
        fitted = stored(dealt.mapInArrow(_packer(capacity), "item long, bin long, at long, fill long"), "fitted")
        moved = placed.join(fitted.select(F.col("item").alias("bin"), F.col("bin").alias("into"), "at"), "bin", "left")
        placed = stored(
            moved.select("item", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")),
            "placed",
        )
        bins = fitted.filter("at = 0").select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        made = bins.count()
        left = bins.filter(F.col("size") < capacity - SLACK)
        stalled, count, step = made > STALLED * count, left.count(), step + 1
        if stalled:
            break
    where = placed.select(F.col("item").alias("__item"), F.col("bin").alias("sequence_id"), "offset")
    return rows.join(where, "__item").drop("__item")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: sequence_id, ids. A group holds at most the capacity."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
    )
