"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

Each task cuts its documents into segments and writes, for every term of a segment, its
postings in compressed blocks, with the least lengths by frequency of each block beside
them. A score bound of a block is found from these once the corpus counts are known, so
the index is built in one pass. A search brings each segment's lists of the queried terms
to one task, which keeps the best k documents of every query; these few rows are merged.
"""

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import stored

#: Postings of a block, terms of a segment's texts, documents scored at a time, queries of a block.
BLOCK, SEGMENT, STRETCH, QUERIES = 128, 3_000_000, 4096, 512
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20

# A term is a run of these bytes of UTF-8, which is one of the contract's characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

INDEX = (
    "segment long, term binary, df long, data binary, ends array<int>, lasts array<int>, "
    "tops array<int>, tf array<int>, least array<long>, ids array<long>, lengths array<long>"
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lower case (A to Z only), slice by slice."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + SLICE) if start + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[start:end].lower())
        start = end


class _Numbers(dict):
    """Numbers of terms in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, the last byte of each below 128; and the length of each."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (values[some] >> (7 * k)) & 127 | np.where(size[some] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that `packed` has put into bytes."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data.astype(np.int64) & 127) << (7 * place), starts)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def segment_rows(segment: int, ids: list, found: list[array], numbers: dict) -> pa.RecordBatch:
    """Index rows of some documents: one of the documents themselves (term NULL) and one a term.

    Documents are numbered by id, NULL ids last, so that of equal scores the first is the best.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(found[i]) for i in order], np.int64)
    tokens = np.concatenate([np.frombuffer(found[i], np.int32) for i in order] or [np.zeros(0, np.int32)]).astype(np.int64)
    docs = np.repeat(np.arange(len(order)), lengths)
    keys = np.sort(tokens << 32 | docs)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    tf = np.diff(first, append=len(keys))
    term, doc = keys[first] >> 32, keys[first] & 0xFFFFFFFF
    # Postings are sorted by term and document; a term's first block begins where the term does.
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(begins, append=len(term))
    rank = np.arange(len(term)) - np.repeat(begins, df)
    before = np.where(rank > 0, np.concatenate(([0], doc[:-1])), -1)
    pairs = np.stack([doc - before, tf], 1).ravel()
    data, sizes = packed(pairs)
    until = np.cumsum(sizes)[1::2]
    opens = np.flatnonzero(rank % BLOCK == 0)
    closes = np.append(opens[1:], len(term)) - 1
    block = np.repeat(np.arange(len(opens)), closes - opens + 1)
    blocks = -(-df // BLOCK)
    base = np.concatenate(([0], until))[begins] if len(begins) else np.zeros(0, np.int64)
    stop = until[begins + df - 1] if len(begins) else base
    # The least length for each frequency in a block bounds the block's scores exactly.
    by = np.lexsort((lengths[doc], tf, block))
    fresh = np.flatnonzero((np.diff(block[by], prepend=-1) != 0) | (np.diff(tf[by], prepend=-1) != 0))
    top_block, top_tf, top_least = block[by][fresh], tf[by][fresh], lengths[doc][by][fresh]
    owner = np.repeat(np.arange(len(df)), blocks)
    top_owner = owner[top_block] if len(owner) else top_block
    first_block = np.cumsum(blocks) - blocks
    tops = np.bincount(top_owner, minlength=len(df))
    names = list(numbers)
    n = len(df)
    none = pa.nulls(n, pa.list_(pa.int64()))
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, segment)),
            pa.array([names[i] for i in term[begins].tolist()], pa.binary()),
            pa.array(df.astype(np.int64)),
            pa.array([data[a:b].tobytes() for a, b in zip(base.tolist(), stop.tolist())], pa.binary()),
            _lists(until[closes] - base[owner], blocks, pa.int32()),
            _lists(doc[closes], blocks, pa.int32()),
            _lists(top_block - first_block[top_owner], tops, pa.int32()),
            _lists(top_tf, tops, pa.int32()),
            _lists(top_least, tops, pa.int64()),
            none,
            none,
        ],
        names=[c.split()[0] for c in INDEX.split(", ")],
    )
    own = pa.RecordBatch.from_pylist(
        [{"segment": segment, "df": len(order), "ids": [ids[i] for i in order], "lengths": lengths.tolist()}], rows.schema
    )
    return pa.Table.from_batches([own, rows]).combine_chunks().to_batches()[0]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    segment = TaskContext.get().partitionId() << 32
    ids, found, numbers, held = [], [], _Numbers(), 0
    for batch in batches:
        names, texts = batch.column("id").to_pylist(), batch.column("text").fill_null("").cast(pa.large_binary())
        for name, text in zip(names, texts):
            own = array("i")
            for some in terms(text.as_py()):
                own.extend(map(numbers.__getitem__, some))
            if own:
                ids.append(name)
                found.append(own)
                held += len(own)
            if held >= SEGMENT:
                yield segment_rows(segment, ids, found, numbers)
                segment, ids, found, numbers, held = segment + 1, [], [], _Numbers(), 0
    if ids:
        yield segment_rows(segment, ids, found, numbers)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with a term, in one pass and without a shuffle.

    Ids must be integers; NULL and repeated ids are documents of their own, NULL texts have
    no terms, further columns are not read. Texts are indexed whole. The rows are meant to
    be stored (`stored`, or Parquet of one's own) and searched many times.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_indexed, INDEX)


def term_lists(column: Column) -> Column:
    """The distinct terms of a text column as binary; NULL has none."""
    lower = F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    return F.transform(F.array_distinct(found), lambda t: t.cast("binary"))


def worth(tf: np.ndarray, lengths: np.ndarray, weight: int, n_docs: int, n_terms: int) -> np.ndarray:
    """Score of a term in documents of these lengths, in whole numbers."""
    m = 50 + (50 * lengths * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Postings:
    """One term's list in a segment: bounds of all blocks, and blocks unpacked when asked for."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ends, self.lasts = np.array(row["ends"]), np.array(row["lasts"])
        tops = worth(np.array(row["tf"], np.int64), np.array(row["least"], np.int64), 1, n_docs, n_terms)
        starts = np.flatnonzero(np.diff(np.array(row["tops"]), prepend=-1))
        self.bounds = np.maximum.reduceat(tops, starts)
        self.bound = int(self.bounds.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of a block."""
        if b not in self.known:
            numbers = unpacked(self.data[self.ends[b - 1] if b else 0 : self.ends[b]])
            base = self.lasts[b - 1] if b else -1
            self.known[b] = base + np.cumsum(numbers[::2]), numbers[1::2]
        return self.known[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents from `low` up to, not including, `high`."""
        a, b = np.searchsorted(self.lasts, [low, high - 1])
        some = [self.block(i) for i in range(a, min(b + 1, len(self.lasts)))]
        if not some:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, tf = (np.concatenate(x) for x in zip(*some))
        inside = slice(*np.searchsorted(docs, [low, high]))
        return docs[inside], tf[inside]

    def at(self, docs: np.ndarray) -> np.ndarray:
        """Frequencies in ascending documents, 0 where there is none; only their blocks are unpacked."""
        out = np.zeros(len(docs), np.int64)
        home = np.searchsorted(self.lasts, docs)
        inside = np.flatnonzero(home < len(self.lasts))
        cuts = np.flatnonzero(np.diff(home[inside], prepend=-1))
        for start, stop in zip(cuts, np.append(cuts[1:], len(inside))):
            rows = inside[start:stop]
            own, tf = self.block(int(home[rows[0]]))
            place = np.minimum(np.searchsorted(own, docs[rows]), len(own) - 1)
            out[rows] = np.where(own[place] == docs[rows], tf[place], 0)
        return out

    def ceiling(self, docs: np.ndarray) -> np.ndarray:
        """Bound of the block in which each document would lie."""
        home = np.searchsorted(self.lasts, docs)
        return np.where(home < len(self.lasts), self.bounds[np.minimum(home, len(self.lasts) - 1)], 0)


def best(lists: list[tuple[int, Postings]], lengths: np.ndarray, k: int, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a segment for (weight, list) pairs, and their scores: Block-Max MaxScore.

    Lists are ordered by their bounds. Those whose bounds together cannot reach the k-th
    score are not essential: a document in none of the others is never looked at, and of
    the rest only those are looked up in such a list whose block there can lift them above it.
    Documents come in ascending order, so a later one of equal score never displaces one.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].bound)
    reach = np.cumsum([w * p.bound for w, p in lists]) if lists else np.zeros(0, np.int64)
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(lengths), STRETCH):
        high = min(low + STRETCH, len(lengths))
        split = int(np.searchsorted(reach, least, "right"))  # lists before it are not essential
        if split == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for weight, postings in lists[split:]:
            own, tf = postings.between(low, high)
            total[own - low] += worth(tf, lengths[own], weight, n_docs, n_terms)
        found = np.flatnonzero(total)
        found = found[total[found] + (reach[split - 1] if split else 0) > least]
        own, part = found + low, total[found]
        for i in range(split - 1, -1, -1):
            weight, postings = lists[i]
            below = reach[i - 1] if i else 0
            able = part + weight * postings.ceiling(own) + below > least
            own, part = own[able], part[able]
            if not len(own):
                break
            part = part + worth(postings.at(own), lengths[own], weight, n_docs, n_terms)
        able = part > least
        docs, scores = np.concatenate([docs, own[able]]), np.concatenate([scores, part[able]])
        if len(docs) > k:
            keep = np.sort(np.lexsort((docs, -scores))[:k])
            docs, scores = docs[keep], scores[keep]
        if len(docs) == k:
            least = int(scores.min())
    return docs, scores


def _searched(k: int) -> Callable:
    def work(lists: pa.Table) -> pa.Table:
        own = lists.filter(pc.is_null(lists.column("term"))).to_pylist()[0]
        ids, lengths = own["ids"], np.array(own["lengths"], np.int64)
        n_docs, n_terms = own["n_docs"], own["n_terms"]
        queries: dict[int, list[tuple[int, Postings]]] = {}
        for row in lists.filter(pc.is_valid(lists.column("term"))).to_pylist():
            postings = Postings(row, n_docs, n_terms)
            for item in row["uses"]:
                queries.setdefault(item, []).append((row["w"], postings))
        items, found, scores = [], [], []
        for item, wanted in queries.items():
            docs, values = best(wanted, lengths, k, n_docs, n_terms)
            items += [item] * len(docs)
            found += [ids[d] for d in docs.tolist()]
            scores += values.tolist()
        return pa.table({"item": pa.array(items, pa.int64()), "doc": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    return work


def search(
    index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text"
) -> DataFrame:
    """The `k` best documents of every query: item, rank, document, score.

    `index` is a stored result of `build_index`. The score is that of BM25 in whole numbers,
    with the counts of the whole index. Of equal scores the smaller id comes first, NULL ids
    last. Every row of `queries` is a query, rows that repeat an id too, whose ranks are
    their own; NULL texts and texts without a known term have no result. No queries or no
    documents give no rows. Further columns of `queries` are not read.
    """
    spark = queries.sparkSession
    ship(spark)
    asked = stored(
        queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), term_lists(F.col(text)).alias("terms")),
        "queries",
    )
    blocks = max(1, -(-asked.count() // QUERIES))
    pairs = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    documents = index.filter("term is null")
    counts = documents.select(
        F.sum("df").alias("n_docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_terms")
    ).first()
    if not counts.n_docs:
        kind = asked.schema["name"].dataType.simpleString()
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    n_docs, n_terms = F.lit(counts.n_docs), F.lit(counts.n_terms)
    df = index.select("term", "df").join(pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    uses = pairs.groupBy("block", "term").agg(F.collect_list("item").alias("uses"))
    wanted = stored(uses.join(df.select("term", weight.alias("w")), "term"), "wanted")
    # Every segment meets every block of queries, with only the lists that the block asks for.
    asked_lists = index.join(wanted, "term")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = documents.withColumns({"block": every, "uses": F.lit(None).cast("array<bigint>"), "w": F.lit(None).cast("long")})
    lists = asked_lists.unionByName(own).withColumns({"n_docs": n_docs, "n_terms": n_terms})
    found = lists.groupBy("segment", "block").applyInArrow(_searched(k), "item long, doc long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score"
    )
