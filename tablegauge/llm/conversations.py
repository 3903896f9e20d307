"""Repair of the turn structure of conversations by a suffix-shared automaton.

A row of a conversation is one letter: its role's initial and its fault, as far as they
decide which edits it allows. The letters of a conversation are its signature. Equal
signatures are repaired once, and signatures with a common end share the nodes of an
automaton for it: read from the end and in order, each node is made once, with the cost
from there to the end and the first edit of the best audit for every state of the grammar.
"""

from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import stored

# Roles of inserted and changed rows, costs, white space.
USER, ASSISTANT = "user", "assistant"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = r"[\x20\x09-\x0D]"
#: Letters of rows: to be deleted; by initial s, u, a or other; the same in capitals if truncated.
GONE, OTHER = "x", "o"

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The one role that may follow in each state besides a kept s.
NEXT = {EMPTY: "u", SYSTEM: "u", ASKED: "a", ANSWERED: "u"}
#: Edits: Keep, Rerole to user or assistant, Delete, Insert user or assistant.
KEEP, TO_USER, TO_ASSISTANT, GO, NEW_USER, NEW_ASSISTANT = "kuadUA"
AUDIT = ("kuadUA", "KRRDII")
#: Cost vectors are kept as small numbers of what a state costs above the cheapest.
Vector = tuple[int, int, int, int]


def _inserted(least: list[int], first: list[str]) -> None:
    """Lets rows be inserted before what the costs were found for; ties go to the lesser audit letter."""
    for _ in range(3):
        for state, role in NEXT.items():
            onward = INSERT + least[STEPS[state, role]]
            # An insertion's letter comes before a keep or a change, and after a deletion.
            if onward < least[state] or (onward == least[state] and first[state] not in "dUA"):
                least[state], first[state] = onward, NEW_USER if role == "u" else NEW_ASSISTANT


@lru_cache(None)
def ending() -> tuple[Vector, int, tuple[str, ...]]:
    """The node after the last row: costs above the least, the least, first edits."""
    least, first = [0, 1 << 40, 1 << 40, 0], ["", "?", "?", ""]
    for state, role in ((ASKED, "a"), (SYSTEM, "u")):
        least[state] = INSERT + least[STEPS[state, role]]
        first[state] = NEW_USER if role == "u" else NEW_ASSISTANT
    return tuple(least), 0, tuple(first)


@lru_cache(None)
def before(letter: str, after: Vector) -> tuple[Vector, int, tuple[str, ...]]:
    """The node of a row's letter before a node with these costs."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    least, first = [], []
    for state in range(4):
        found = [(DELETE + after[state], "D", GO)]
        if role != GONE:
            if (state, role) in STEPS:
                found.append((extra + after[STEPS[state, role]], "K", KEEP))
            wanted = NEXT[state]
            found.append((REROLE + extra + after[STEPS[state, wanted]], "R", TO_USER if wanted == "u" else TO_ASSISTANT))
        cost, _, edit = min(found)
        least.append(cost)
        first.append(edit)
    _inserted(least, first)
    low = min(least)
    return tuple(x - low for x in least), low, tuple(first)


class Automaton:
    """The nodes from the end of a sequence up to where the reader is, shared by all signatures with that end.

    Nodes with equal costs and edits are one object; a place in the sequence takes a
    reference and a number.
    """

    def __init__(self):
        self.letters, self.nodes, self.low = "", [ending()], array("q", [0])

    def read(self, backward: str) -> None:
        """Moves to a signature given from its end: nodes of the common end stay, others are made."""
        same, limit = 0, min(len(self.letters), len(backward))
        while same < limit:
            middle = (same + limit + 1) // 2
            if self.letters[same:middle] == backward[same:middle]:
                same = middle
            else:
                limit = middle - 1
        del self.nodes[same + 1 :], self.low[same + 1 :]
        for letter in backward[same:]:
            node = before(letter, self.nodes[-1][0])
            self.nodes.append(node)
            self.low.append(self.low[-1] + node[1])
        self.letters = backward

    def best(self) -> tuple[int, str]:
        """Cost and edits of the cheapest repair, of equal ones that with the least audit."""
        edits, state = [], EMPTY
        for at in range(len(self.nodes) - 1, -1, -1):
            first = self.nodes[at][2]
            while (edit := first[state]) in (NEW_USER, NEW_ASSISTANT):
                edits.append(edit)
                state = STEPS[state, edit.lower()]
            if at:
                edits.append(edit)
                if edit != GO:
                    state = STEPS[state, self.letters[at - 1].lower() if edit == KEEP else edit]
        return self.low[-1] + self.nodes[-1][0][EMPTY], "".join(edits)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        costs, edits = [], []
        for backward in batch.column("backward").to_pylist():
            automaton.read(backward)
            cost, plan = automaton.best()
            costs.append(cost)
            edits.append(plan)
        columns = [batch.column("backward"), pa.array(costs, pa.int64()), pa.array(edits, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["backward", "cost", "edits"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of `conversations` as the contract damages them: with `copies` of 0, 1 or 2, and a row number.

    NULL roles and texts become one space; so do NULL ids and turns, but only in the string
    that chooses the damage. Further columns are not read.
    """
    number = F.pmod(
        F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")), F.lit(20)
    )
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hurt = F.when(number == 1, F.lit("")).when(number == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select(
        "conv_id",
        "turn",
        F.when(number == 4, F.lit(USER)).otherwise(role).alias("role"),
        hurt.alias("text"),
        F.when(number == 0, 0).when(number == 3, 2).otherwise(1).alias("copies"),
        F.monotonically_increasing_id().alias("row"),
    )


#: Order of a conversation's rows; rows of the same turn keep the table's order.
PLACE = ["conv_id", "turn", "row", "copy"]


def faults(rows: DataFrame) -> DataFrame:
    """Every row's first fault: blank, duplicate (of an earlier role and text) or truncated, else NULL.

    `rows` has conv_id, turn, role, text, copies and a unique row number; the result has a
    row for each copy, and for a dropped row one with copy NULL. Equal texts meet only as
    digests, summed up before they are shuffled.
    """
    copy = F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    solid = F.regexp_replace("text", BLANKS + "+$", "")
    narrow = rows.select(
        "conv_id", "turn", "row", "copies", F.substring("role", 1, 1).alias("initial"), key.alias("key"),
        (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("row").alias("c"))
    seen = narrow.filter("copies > 0").groupBy("conv_id", "key").agg(F.min(place).alias("first"))
    firsts = seen.select(F.col("first.c").alias("row"), F.lit(True).alias("fresh"))
    known = narrow.join(firsts, "row", "left").withColumn("copy", copy)
    again = F.col("fresh").isNull() | (F.col("copy") > 1)
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    return known.select("conv_id", "turn", "row", "copy", "initial", F.when(F.col("copy").isNotNull(), fault).alias("fault"))


def letter() -> Column:
    """The row's letter in its conversation's signature."""
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit(OTHER))
    return (
        F.when(F.col("copy").isNull(), F.lit(""))
        .when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE))
        .when(F.col("fault") == "truncated", F.upper(role))
        .otherwise(role)
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows one row for each conversation and task: its letters there, and pairs of roles out of order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["conv_id", "part", "letters", "illegal", "head", "tail"]
    kind = None

    def rows(held: list) -> pa.RecordBatch:
        columns = [pa.array([x[0] for x in held], kind), pa.array([part] * len(held), pa.int32())]
        columns += [pa.array([x[i] for x in held], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.string()), (4, pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    held, current = [], None
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, mark, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letter", "initial"))):
            if current is None or current[0] != conv:
                if current:
                    held.append((current[0], "".join(current[1]), *current[2:]))
                current = [conv, [], 0, None, None]
            if mark:
                if current[3] is None:
                    current[3] = initial
                else:
                    current[2] += current[4] + initial not in ("su", "ua", "au")
                current[4] = initial
                current[1].append(mark)
        if len(held) > 10_000:
            yield rows(held)
            held = []
    if current:
        held.append((current[0], "".join(current[1]), *current[2:]))
        yield rows(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired conversations from sorted rows: a conversation's edits, then its rows in order."""
    roles = {NEW_USER: USER, NEW_ASSISTANT: ASSISTANT, TO_USER: USER, TO_ASSISTANT: ASSISTANT}
    plan, at, digest, began = "", 0, None, False
    convs, hashes, kind = [], [], None

    def put(role: str, text: str) -> None:
        nonlocal began
        digest.update(("\n" if began else "").encode() + role.encode() + b":" + text.encode())
        began = True

    def inserts() -> None:
        nonlocal at
        while at < len(plan) and plan[at] in "UA":
            put(roles[plan[at]], "")
            at += 1

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text"))):
            if edits is not None:
                if digest:
                    inserts()
                    hashes.append(digest.hexdigest())
                convs.append(conv)
                plan, at, digest, began = edits, 0, sha256(), False
                continue
            inserts()
            edit, at = plan[at], at + 1
            if edit != GO:
                put(roles.get(edit, role), text)
        if len(hashes) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(convs[: len(hashes)], kind), pa.array(hashes)], names=["conv_id", "repaired_sha256"])
            convs, hashes = convs[len(hashes) :], []
    if digest:
        inserts()
        hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes)], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """Faults of every conversation, and the cheapest edits that give its roles the form (s?(ua)+)?.

    `rows` has conv_id, turn, role, text and, as `damaged` gives them, copies (0: dropped) and
    row. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and edits (one
    letter an edit: k keeps a row, u and a give it the role user or assistant, d deletes it, U and A
    insert one). NULL ids are one conversation; NULL turns come first; rows of one turn keep
    their order; conversations without rows have zeros and no edits; an empty table gives no
    rows. A role is known by its first character, and one without any must be changed.

    Rows are sorted over the whole cluster by conversation and turn, so that a long
    conversation is cut where a task ends; only its letters, one a row, meet.
    """
    spark = rows.sparkSession
    ship(spark)
    marked = stored(faults(rows).withColumn("letter", letter()), "letters")
    kind = marked.schema["conv_id"].dataType.simpleString()
    ranged = marked.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    schema = f"conv_id {kind}, part int, letters string, illegal long, head string, tail string"
    parts = ranged.select("conv_id", "letter", "initial").mapInArrow(_stretches, schema)
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "illegal", "head", "tail"))).alias("parts"))
    # Where a conversation goes on in the next task, the pair of roles between them counts too.
    full = F.filter("parts", lambda p: p["letters"] != "")
    between = F.expr(
        "size(filter(zip_with(slice(full, 1, greatest(size(full) - 1, 0)), slice(full, 2, size(full)), (a, b) -> a.tail || b.head),"
        " p -> p not in ('su', 'ua', 'au')))"
    )
    whole = joined.withColumn("full", full).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["letters"]), "").alias("letters"),
        (F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["illegal"]) + between).alias("illegal"),
    )
    signed = stored(whole.withColumn("backward", F.reverse("letters")).drop("letters"), "signatures")
    turns = marked.filter("copy is not null").groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    # Sorted from their ends, signatures with a common end are neighbours and share its nodes.
    distinct = signed.select("backward").distinct().repartitionByRange("backward").sortWithinPartitions("backward")
    plans = stored(distinct.mapInArrow(_repaired, "backward string, cost long, edits string"), "plans")
    found = signed.join(plans, "backward").drop("backward")
    same = found["conv_id"].eqNullSafe(counts["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    return found.join(counts, same, "left").select(
        found["conv_id"], *zero, "illegal", "cost", F.translate("edits", *AUDIT).alias("audit"), "edits"
    )


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """SHA-256 of every repaired conversation, its rows as role:text on lines: conv_id, repaired_sha256.

    A digest is sequential, so a conversation streams through one task, row by row and
    sorted by Spark; besides its edits, one letter each, nothing of it is held.
    """
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    texts = rows.filter("copies > 0").select("conv_id", "turn", "row", copy.alias("copy"), "role", "text", F.lit(None).cast("string").alias("edits"))
    head = {"turn": "turn", "row": "row", "copy": "copy"}
    plans = repairs.select(
        "conv_id",
        *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in head],
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        "edits",
    )
    stream = plans.unionByName(texts).withColumn("later", F.col("edits").isNull())
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "later", "turn", "row", "copy")
    return ordered.select("conv_id", "edits", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 1), role, text.

    Each conversation's edits are dealt out to its rows by number; inserted rows have empty texts.
    """
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    texts = rows.filter("copies > 0").select("conv_id", "turn", "row", copy.alias("copy"), "role", "text")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "row", "copy"))
    steps = repairs.select("conv_id", F.posexplode(F.split("edits", "")).alias("step", "edit")).filter("edit <> ''")
    taken = F.count_if(~F.col("edit").isin(NEW_USER, NEW_ASSISTANT)).over(
        Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    )
    steps = steps.withColumn("nth", F.when(~F.col("edit").isin(NEW_USER, NEW_ASSISTANT), taken))
    rowed = texts.withColumn("nth", nth)
    same = steps["conv_id"].eqNullSafe(rowed["conv_id"]) & (steps["nth"] == rowed["nth"])
    edit = F.lower("edit")
    role = F.when(edit == "u", F.lit(USER)).when(edit == "a", F.lit(ASSISTANT)).otherwise(rowed["role"])
    kept = steps.join(rowed, same, "left").filter(F.col("edit") != GO)
    place = F.row_number().over(Window.partitionBy(steps["conv_id"]).orderBy("step"))
    return kept.select(steps["conv_id"], place.alias("place"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
