"""Repeated byte strings, found by external induced sorting of suffixes.

Only sampled suffixes are sorted by content; the order of all others follows from it.

* Sample. Of the hashes of 30-byte strings that a 100-byte string holds, the least marks
  an anchor (the last one of equals). Equal 100-byte strings have equal anchors at equal
  places. Anchors that occur once are dropped.
* Sort. Suffixes at equal anchors meet in one task, sorted by Spark's external sort,
  which spills to disk. They are sorted by their next 100 bytes with the lengths of
  common prefixes between neighbours.
* Induction. The suffixes one byte further left are ordered by that byte and then by the
  order just known; common prefixes grow by one or are range minima. After s steps
  neighbours that share 100 bytes are equal strings that begin s bytes before the anchor.
  Suffixes that can no longer reach 100 bytes leave the queue.

A task takes whole anchors, a bounded number of suffixes at a time. Anchors with more
suffixes than one batch may hold go another way: their strings are compared by 128-bit
hashes in an aggregation, which has no hot task.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import mixed, stored, text_chunks

LENGTH, GRAM = 100, 30
WINDOW = LENGTH - GRAM + 1
#: Suffixes of one anchor that a task sorts at most, and of a batch of anchors.
CROWD, BATCH = 100_000, 40_000
#: Rows of windows that are gathered at once, and texts that are cut at once.
GATHER, CUT = 20_000, 1_000
#: Stands for a NULL id; such rows come last.
NO_ID = (1 << 63) - 1

_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def gram_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes at each place of `data` that has `length` of them."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _STEPS[which]))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(pow(int(_STEPS[which]), -1, 1 << 64))))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[which][data] * power[:-1], dtype=np.uint64)))
    return mixed((sums[length:] - sums[:-length]) * back)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in the text) of the anchors of consecutive texts."""
    hashes = gram_hashes(data, GRAM)
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = _least((hashes & ~low) | (low - places), WINDOW)
    # A window counts if its 100 bytes lie within one text.
    text = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    least = least[np.arange(len(least)) + LENGTH <= offsets[text + 1]]
    chosen = low - (least & low)
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))].astype(np.int64) if len(chosen) else chosen.astype(np.int64)
    owner = np.searchsorted(offsets, chosen, "right") - 1
    return hashes[chosen], owner, chosen - offsets[owner]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts; `sure` ones occur twice in the batch. Of those one more row, a probe, tells others."""
    for batch in batches:
        ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
        parts = []
        for row, data, offsets in text_chunks(batch.column("text")):
            found, owner, place = anchors(data, offsets)
            parts.append((found, owner + row, place))
        if not parts:
            continue
        found, owner, place = (np.concatenate(p) for p in zip(*parts))
        distinct, at, counts = np.unique(found, return_inverse=True, return_counts=True)
        state = (counts[at] > 1).astype(np.int8)
        probes = distinct[counts > 1]
        none = np.zeros(len(probes), np.int64)
        columns = [
            np.concatenate((found, probes)).view(np.int64),
            np.concatenate((ids[owner], none)),
            np.concatenate((subs[owner], none)),
            np.concatenate((place, none)).astype(np.int32),
            np.concatenate((state, np.full(len(probes), 2, np.int8))),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "id", "sub", "place", "state"])


def _ragged(data: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int, kind: pa.DataType) -> pa.Array:
    """Byte strings of `data` that begin at given places and run forwards or backwards."""
    ends = np.concatenate(([0], np.cumsum(length)))
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
    body = data[np.repeat(begin, length) + step * within]
    return pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])


def _listed(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Bounds of the lists of structs in a column, and the structs' fields."""
    column = column.fill_null([]) if column.null_count else column
    values = column.flatten()
    bounds = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))))
    return bounds.astype(np.int64), *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _alike(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bytes to the left and to the right of each place."""
    found = []
    for which, begin, end in ((0, at - left, at), (1, at, at + right)):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _STEPS[which]))), dtype=np.uint64)
        back = np.uint64(pow(int(_STEPS[which]), -1, 1 << 64))
        undo = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), back))), dtype=np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[which][data] * power[:-1], dtype=np.uint64)))
        found.append(mixed((sums[end] - sums[begin]) * undo[begin]) + (end - begin).astype(np.uint64))
    return found[0], found[1]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor of a text the bytes to its left, nearest first, and to its right.

    Of equal windows of one chunk of texts only the earliest is sent; for the others,
    whose strings all occur there already, come the places where strings begin, without bytes.
    """
    names = ["anchor", "id", "sub", "place", "until", "lefts", "rights"]
    for batch in batches:
        ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
        bounds, anchor, place = _listed(batch.column("marks"), "anchor", "place")
        for row, data, offsets in text_chunks(batch.column("text")):
            some = slice(bounds[row], bounds[row + len(offsets) - 1])
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[row : row + len(offsets)]))
            marks, here = anchor[some], place[some].astype(np.int64)
            at, owner, share = offsets[text] + here, ids[row + text], subs[row + text]
            left, right = np.minimum(here, WINDOW - 1), np.minimum(offsets[text + 1] - at, LENGTH)
            x, y = _alike(data, at, left, right)
            order = np.lexsort((here, share, owner, x, y))
            again = np.concatenate(([False], (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])))[: len(order)]
            known, fresh = order[again], order[~again]
            first, last = here[known] - left[known], here[known] - (LENGTH - right[known])
            real = first <= last
            none = pa.nulls(int(real.sum()), pa.binary())
            columns = [marks[known][real], owner[known][real], share[known][real], first[real].astype(np.int32), last[real].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), none, none], names=names)
            for lo in range(0, len(fresh), GATHER):
                i = fresh[lo : lo + GATHER]
                none = pa.nulls(len(i), pa.int32())
                columns = [pa.array(c) for c in (marks[i], owner[i], share[i], here[i].astype(np.int32))]
                bytes_ = (_ragged(data, at[i] - 1, left[i], -1, pa.binary()), _ragged(data, at[i], right[i], 1, pa.binary()))
                yield pa.RecordBatch.from_arrays([*columns, none, *bytes_], names=names)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of bytes, padded with 0, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, lengths


def induced(group: np.ndarray, left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each suffix and each number s of steps to the left: does the 100-byte string there occur at an earlier age?

    `group` tells anchors apart; ages are distinct.
    """
    n = len(group)
    found = np.zeros((n, WINDOW), bool)
    wide = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    wide[:, :LENGTH] = right
    columns = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], group))
    differ = right[order[1:]] != right[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.minimum(common, np.minimum(right_n[order[1:]], right_n[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = 0
    common = np.concatenate(([0], common))
    for s in range(WINDOW):
        if not len(order):
            break
        border = common < LENGTH
        if not border.all():
            begins = np.flatnonzero(border)
            eldest = np.minimum.reduceat(age[order], begins)
            found[order, s] = age[order] != eldest[np.cumsum(border) - 1]
        if s == WINDOW - 1:
            break
        # Leave the queue: suffixes at a text's start, and those too unlike their neighbours.
        reach = np.maximum(common, np.concatenate((common[1:], [0])))
        stay = np.flatnonzero((reach >= GRAM + s) & (left_n[order] > s))
        if not len(stay):
            break
        common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
        order = order[stay]
        key = group[order] * 256 + left[order, s]
        moved = np.argsort(key, kind="stable")
        same = key[moved[1:]] == key[moved[:-1]]
        grown = np.zeros(len(order), np.int64)
        if same.any():
            first, last = moved[:-1][same] + 1, moved[1:][same] + 1
            pairs = np.stack((first, last), axis=1).ravel()
            grown[1:][same] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
        common, order = grown, order[moved]
    return found


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places at which repeated strings begin, from windows that come sorted by anchor."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        anchor, ids, subs, place = (column[c].to_numpy() for c in ("anchor", "id", "sub", "place"))
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        age = np.empty(len(ids), np.int64)
        age[np.lexsort((place, subs, ids))] = np.arange(len(ids))
        found = induced(group, *_matrix(column["lefts"], WINDOW - 1), *_matrix(column["rights"], LENGTH), age)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, nearest = np.nonzero(edge == 1)
        farthest = np.nonzero(edge == -1)[1] - 1
        return _ranges(ids[row], subs[row], place[row] - farthest, place[row] - nearest)

    for given in batches:
        known = given.filter(given.column("until").is_valid())
        yield _ranges(*(known.column(c).to_numpy() for c in ("id", "sub", "place", "until")))
        batch = given.filter(given.column("until").is_null())
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < BATCH:
            continue
        table = pa.Table.from_batches(held)
        last = table.column("anchor")[-1].as_py()
        done = int(np.searchsorted(table.column("anchor").to_numpy(), last))
        if done:
            yield work(table.slice(0, done))
            held = table.slice(done).combine_chunks().to_batches()
    if held:
        yield work(pa.Table.from_batches(held))


def _ranges(ids: np.ndarray, subs: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(ids, pa.int64()), pa.array(subs, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "sub", "first", "last"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all strings that crowded anchors stand for."""
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("id", "sub", "place", "lefts", "rights")))
        for ident, sub, place, left, right in rows:
            text = np.frombuffer(left[::-1] + right, np.uint8)
            x, y = (gram_hashes(text, LENGTH, k) for k in (0, 1))
            begin = place - len(left)
            out += [(int(a), int(b), ident, sub, begin + k) for k, (a, b) in enumerate(zip(x.view(np.int64), y.view(np.int64)))]
        kinds = [pa.int64()] * 4 + [pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["x", "y", "id", "sub", "first"]
        )


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes that strings beginning from `first` to `last` cover, apart from each other."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new], end[np.concatenate((new[1:] - 1, [len(end) - 1]))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text once its repeated strings are gone."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), span, pa.string()]
    for whole in batches:
        for lo in range(0, whole.num_rows, CUT):
            batch = whole.slice(lo, CUT)
            texts = batch.column("text").fill_null("").cast(pa.large_binary())
            bounds, first, last = _listed(batch.column("found"), "first", "last")
            rows = []
            for i, text in enumerate(texts):
                text, some = text.as_py(), slice(bounds[i], bounds[i + 1])
                begins, ends = merged(first[some], last[some]) if bounds[i] < bounds[i + 1] else ((), ())
                digest, at = hashlib.sha256(), 0
                for begin, end in zip(begins, ends):
                    digest.update(text[at:begin])
                    at = end
                digest.update(text[at:])
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(begins, ends)]
                rows.append((len(text), int(sum(ends) - sum(begins)), spans, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"],
            )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, spans (begin, end) and kept_sha256.

    A byte is removed if a 100-byte string of its text that covers it begins earlier as
    well: in a row with a smaller id (NULL ids last; rows that share an id are ordered by
    a hash of the text), or earlier in the same text. Matches never cross texts and are
    judged on the texts as given. NULL is empty. Rows with equal id and text are one text.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    given = docs.select(ident.alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    repeated = not given.groupBy("id").count().filter("count > 1").isEmpty()
    sub: Column = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    given = given.select("id", sub.alias("sub"), "text")

    # Texts equal to an earlier one go as a whole; they need no sorting.
    names = stored(
        given.filter(F.octet_length("text") >= LENGTH).select(
            "id", "sub", F.octet_length("text").alias("bytes"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")
        ),
        "names",
    )
    firsts = names.groupBy("key").agg(F.min(F.struct("id", "sub")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(
        names.join(stored(firsts, "firsts"), "key")
        .filter("id <> first.id or sub <> first.sub")
        .select("id", "sub", F.lit(0).alias("first"), (F.col("bytes") - LENGTH).cast("int").alias("last"))
        .distinct(),
        "copies",
    )

    # Anchors that occur twice or more, outside of copies. Sure ones need no company, so
    # each takes a lane of its own and a frequent anchor is no hot key.
    seen = given.mapInArrow(_anchored, "anchor long, id long, sub long, place int, state byte")
    lane = F.when(F.col("state") == 1, F.xxhash64("id", "sub", "place")).otherwise(0)
    alone = seen.withColumn("lane", lane).withColumn("n", F.count("*").over(Window.partitionBy("anchor", "lane")))
    met = alone.filter("state = 1 or state = 0 and n > 1").select("anchor", "id", "sub", "place")
    outside = stored(met.join(copies.select("id", "sub"), ["id", "sub"], "left_anti"), "met")
    crowds = stored(outside.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowd), "crowds")
    crowded = not crowds.isEmpty()
    marks = outside.withColumn("crowded", F.lit(False))
    if crowded:
        marks = outside.join(crowds, "anchor", "left").withColumn("crowded", F.col("n").isNotNull())
    by_text = marks.groupBy("id", "sub").agg(F.collect_list(F.struct("anchor", "place", "crowded")).alias("marks"))
    texts = given.dropDuplicates(["id", "sub"]) if repeated else given

    def windows(of_crowds: bool) -> DataFrame:
        some = by_text.withColumn("marks", F.filter("marks", lambda m: m.crowded == F.lit(of_crowds))).filter("size(marks) > 0")
        return texts.join(some, ["id", "sub"]).mapInArrow(
            _windows, "anchor long, id long, sub long, place int, until int, lefts binary, rights binary"
        )

    found = stored(
        windows(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted, "id long, sub long, first int, last int"),
        "found",
    ).union(copies)
    if crowded:
        crowd_windows = stored(windows(True), "crowded")
        known = crowd_windows.filter("until is not null").select("id", "sub", F.col("place").alias("first"), F.col("until").alias("last"))
        found = found.union(known)
        strings = stored(crowd_windows.filter("until is null").mapInArrow(_hashed, "x long, y long, id long, sub long, first int"), "strings")
        eldest = strings.groupBy("x", "y").agg(F.min(F.struct("id", "sub", "first")).alias("e"), F.count("*").alias("n")).filter("n > 1")
        later = strings.join(stored(eldest, "eldest"), ["x", "y"]).filter(F.struct("id", "sub", "first") != F.col("e"))
        found = found.union(later.select("id", "sub", "first", F.col("first").alias("last")))
    spans = stored(found.groupBy("id", "sub").agg(F.collect_list(F.struct("first", "last")).alias("found")), "spans")
    cut = given.join(spans, ["id", "sub"], "left").select("id", "text", "found").mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept_sha256 string"
    )
    return cut.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
