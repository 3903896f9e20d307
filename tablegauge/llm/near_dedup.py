"""Near duplicates by ProbMinHash over weighted word shingles.

Each distinct five-word shingle of a text weighs 1 + ln(its count). Every shingle starts
a Poisson process of that rate whose arrivals fall on random registers; a register keeps
the shingle that arrives first. Shingles stop as soon as their next arrival is later than
every register's. Equal registers estimate the probability Jaccard of two texts; bands of
registers give candidates; candidates are verified by the exact Jaccard of their sets. As
that is the measure of a link, texts with repeated shingles have a second sketch in which
all shingles weigh the same, so that no repeats hide a link.

Within a bucket no list of all pairs is made. Members are compared with one hub first;
only members that verified links have not joined yet are compared among themselves, block
by block inside tasks, which return no more links than join their blocks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import WINDOW, mixed, shingle_hashes, stored, text_chunks, text_key, word_hashes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Members of one block are compared exactly if so many registers agree: four deviations below 0.8.
LIKELY = 0.66
BLOCK = 256
#: Eighths of the unsettled buckets that each round of block comparisons takes.
ROUNDS = ((0, 1), (1, 3), (3, 8))

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their counts; a shorter text is one shingle."""
    return np.unique(shingle_hashes(words, max(1, min(WINDOW, len(words)))), return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element that reaches each register first.

    The k-th arrival of an element depends on the element and k alone, so sketches of
    different texts can be compared. Without elements every register is 0.
    """
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    at, done = np.zeros(len(elements)), 0
    while len(elements):
        ahead = max(1, min(3 * registers // len(elements), 3 * registers))
        steps = np.arange(done + 1, done + ahead + 1, dtype=np.uint64) * _STEP
        drawn = mixed(elements[:, None] + steps)
        waits = -np.log(((drawn >> np.uint64(11)) + 0.5) * 2.0**-53) / weights[:, None]
        times = at[:, None] + np.cumsum(waits, axis=1)
        place = (mixed(drawn) % np.uint64(registers)).astype(np.int64).ravel()
        came = times.ravel()
        early = np.flatnonzero(came < first[place])
        np.minimum.at(first, place[early], came[early])
        won = early[came[early] == first[place[early]]]
        owner[place[won]] = elements[won // ahead]
        at = times[:, -1]
        still = at < first.max()
        elements, weights, at, done = elements[still], weights[still], at[still], done + ahead
    return owner


def _marks(owner: np.ndarray) -> np.ndarray:
    """The band values of a sketch; weighted and unit sketches share the buckets."""
    rows = owner.reshape(BANDS, ROWS)
    mark = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        mark = mixed(mark * _STEP + rows[:, k])
    return mark


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the identity of its weighted set, its bands, and 16 bits of each register of its plain set."""
    salts = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for batch in batches:
        keys, bands, registers, ends = [], [], [], [0]
        for _, data, offsets in text_chunks(batch.column("text")):
            words, bounds = word_hashes(data, offsets)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                found, counts = shingles(words[lo:hi])
                pair = [int((mixed(found ^ s) * counts.astype(np.uint64)).sum(dtype=np.uint64)) for s in salts[:2]]
                keys.append(b"".join(x.to_bytes(8, "little") for x in pair))
                # Links are defined by the sets, so texts with repeats are sketched as sets too.
                weights = [1 + np.log(counts), np.ones(len(found))] if (counts > 1).any() else [np.ones(len(found))]
                owners = [prob_minhash(found, w) for w in weights] if len(found) else []
                marks = np.concatenate([np.zeros(0, np.uint64), *[_marks(owner) for owner in owners]])
                bands.append(np.unique(marks).view(np.int64))
                registers.append((owners[-1] & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if owners else b"")
                ends.append(ends[-1] + len(bands[-1]))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"],
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))),
                pa.array(registers, pa.binary()),
            ],
            names=[*[n for n in batch.schema.names if n != "text"], "key", "bands", "registers"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, data, offsets in text_chunks(batch.column("text")):
            words, bounds = word_hashes(data, offsets)
            found += [shingles(words[lo:hi])[0].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "shingles"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, each an array of distinct values, is high enough."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= SIMILARITY * (len(both) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(batch.column("left"), batch.column("right"))
        alike = [similar(*(np.frombuffer(s.as_py(), np.uint64) for s in pair)) for pair in sides]
        rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
        yield rows.filter(pa.array(alike, pa.bool_()))


def _compared(group: pa.Table) -> pa.Table:
    """Links that join different labels of two blocks (or within one), as many as needed."""
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    keys, labels = group.column("key").to_pylist(), group.column("label").to_pylist()
    seen = np.stack([np.frombuffer(r, np.uint16) for r in group.column("registers").to_pylist()])
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    block = np.array(group.column("block").to_pylist())
    joined = {label: label for label in labels}

    def root(label: bytes) -> bytes:
        while joined[label] != label:
            label = joined[label]
        return label

    found: tuple[list, list] = ([], [])
    for i in np.flatnonzero(block == lo).tolist():
        others = np.flatnonzero(block == hi)
        others = others[others > i] if lo == hi else others
        agree = (seen[others] == seen[i]).mean(axis=1)
        for j in others[np.argsort(-agree, kind="stable")][: int((agree >= LIKELY).sum())].tolist():
            x, y = root(labels[i]), root(labels[j])
            if x != y and similar(sets[i], sets[j]):
                joined[x] = y
                found[0].append(keys[i])
                found[1].append(keys[j])
    return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every end of `edges` (a, b); label is the smallest key connected to it.

    Each round takes the smallest label among the neighbours and then follows labels
    once, so the rounds grow with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key"))
        lower = labels.join(near.agg(F.min("label").alias("seen")), "key").select(
            "key", F.col("label").alias("old"), F.least("label", "seen").alias("via")
        )
        jumped = lower.join(labels.select(F.col("key").alias("via"), F.col("label").alias("far")), "via").select(
            "key", "old", F.least("via", "far").alias("label")
        )
        new = stored(jumped, "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def _labelled(df: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(column))
    own = labels.select(F.col("key").alias(column), F.col("label").alias(name))
    return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, text_key, class_id and kept (one row of each class).

    Rows are linked if the sets of their five-word shingles have a Jaccard similarity of
    0.8 or more; classes are what links connect, and `class_id` is the smallest id of
    the class (NULL ids last). A text of fewer than five words is one shingle. Texts with
    equal words always share a class, so NULL, empty and blank texts form one. Repeated
    ids are separate rows. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    rows = stored(
        given.mapInArrow(_sketches, f"id {kind}, text_key binary, key binary, bands array<bigint>, registers binary")
        .withColumn("row", F.monotonically_increasing_id()),
        "sketches",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "row"))
    keyed = stored(rows.groupBy("key").agg(first.alias("first")), "keys")

    # Buckets of two keys or more, and the hub (smallest key) of each.
    banded = rows.select("key", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).filter("hub <> top")
    members = stored(
        banded.join(stored(hubs.select("band", "hub"), "hubs"), "band").filter("key <> hub").distinct(), "members"
    )

    # The shingles of every key that shares a bucket, from one of its texts.
    wanted = members.select("key").union(members.select("hub")).distinct()
    where = wanted.join(keyed, "key").select("key", F.col("first.id").alias("at"), F.col("first.text_key").alias("of"))
    fetched = given.join(where, F.col("id").eqNullSafe(F.col("at")) & (F.col("text_key") == F.col("of")))
    sets = stored(
        fetched.select("key", "text").mapInArrow(_sets, "key binary, shingles binary").dropDuplicates(["key"]), "sets"
    )

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("left")), "a").join(
            sets.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b"
        )
        return stored(both.select("a", "b", "left", "right").mapInArrow(_verified, "a binary, b binary"), "verified")

    # First the hub that a key shares most buckets with, then its other hubs, if needed.
    shared = stored(members.groupBy("key", "hub").agg(F.count("*").alias("n")), "shared")
    best = shared.groupBy("key").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    edges = verify(best.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    labels = None if edges.isEmpty() else components(edges)
    others = shared.join(best, ["key", "hub"], "left_anti").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    apart = _labelled(_labelled(others, labels, "a", "x"), labels, "b", "y").filter("x <> y").select("a", "b")
    edges, labels = _more(edges, labels, verify(apart))

    # Buckets whose members are not all connected: compare those members block by block.
    registers = rows.groupBy("key").agg(F.first("registers").alias("registers"))
    for low, high in ROUNDS:
        turn = members.filter(F.expr(f"pmod(xxhash64(band), 8) between {low} and {high - 1}"))
        within = _labelled(turn, labels, "key", "label")
        unsettled = stored(
            within.groupBy("band")
            .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"))
            .filter("least <> most")
            .select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
            "unsettled",
        )
        if unsettled.isEmpty():
            continue
        split = (
            within.join(unsettled, "band")
            .withColumn("block", F.expr("pmod(hash(key), blocks)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("band", "key", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        )
        known = stored(split.select("key").distinct().join(sets, "key").join(registers, "key"), "known")
        links = split.join(known, "key").groupBy("band", "lo", "hi").applyInArrow(_compared, "a binary, b binary")
        edges, labels = _more(edges, labels, stored(links, "compared"))

    classed = stored(_labelled(keyed, labels, "key", "label"), "classed")
    heads = classed.groupBy("label").agg(F.min("first").alias("head"))
    by_key = stored(classed.join(heads, "label").select("key", "head"), "classes")
    return rows.select("id", "text_key", "key", "row").join(by_key, "key").select(
        F.col("id").alias(id_col),
        "text_key",
        F.col("head.id").alias("class_id"),
        (F.col("row") == F.col("head.row")).alias("kept"),
    )


def _more(edges: DataFrame, labels: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    if new.isEmpty():
        return edges, labels
    edges = edges.union(new)
    return edges, components(edges)
