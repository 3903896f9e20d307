"""Conversation repair against a brute-force version."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tablegauge.llm import conversations
from tablegauge.llm.queries import QUERIES
from tests.llm.awkward import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def by_hand(rows):
    """Contract of the query, conversation by conversation, with whole audits compared as strings."""
    found, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        number = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if number == 1 else re.sub("[.!?]", "", text) if number == 2 else text
        role = "user" if number == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if number == 0 else 2 if number == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marks = set(), []
        for _, role, text in own:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            marks.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        @lru_cache(None)
        def best(i, state, inserted):
            options = []
            if i == len(own) and state in ("", "a"):
                options.append((0, "", ()))
            if inserted < 2:
                for role in ("user", "assistant"):
                    if role[0] in STEPS[state]:
                        cost, audit, out = best(i, role[0], inserted + 1)
                        options.append((cost + 2, "I" + audit, ((role, ""), *out)))
            if i < len(own):
                _, role, text = own[i]
                cost, audit, out = best(i + 1, state, 0)
                options.append((cost + 3, "D" + audit, out))
                if marks[i] not in ("blank", "duplicate"):
                    extra = marks[i] == "truncated"
                    if role[:1] in STEPS[state]:
                        cost, audit, out = best(i + 1, role[0], 0)
                        options.append((cost + extra, "K" + audit, ((role, text), *out)))
                    for to in ("user", "assistant"):
                        if to[0] in STEPS[state]:
                            cost, audit, out = best(i + 1, to[0], 0)
                            options.append((cost + extra + 2, "R" + audit, ((to, text), *out)))
            return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

        cost, audit, out = best(0, "", 0)
        text = "\n".join(f"{role}:{text}" for role, text in out)
        counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def run(spark, folder, rows, change=lambda df: df):
    df = change(spark.createDataFrame(rows, SCHEMA))
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    found = QUERIES["op11_conversation_repair"](spark, str(folder)).collect()
    assert len(found) == len({r[0] for r in found})
    return {r[0]: tuple(r[1:9]) for r in found}


def random_rows(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "a", "s"]
    texts = ["A line.", "Another line!", "cut of", "", " \t", None, "Is it?", "Ends with blanks.  \n", "ä ö", "Zeile.\nzwei"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randint(0, 99)}."
            rows.append((conv, None if rng.random() < 0.03 else turn * rng.choice([1, 1, 2]), rng.choice(roles), text))
    # One row a turn, so that only the turn orders them.
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


def test_random_conversations_equal_brute_force(spark, tmp_path):
    rows = random_rows(400, 1)
    assert run(spark, tmp_path, rows) == by_hand(rows)


def test_given_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r[1:9]) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert found == by_hand(rows)


def test_awkward_rows(spark, tmp_path):
    rows = [
        (None, 1, "user", "No id."), (None, 2, "assistant", "Nor here."), (None, None, None, None),
        (7, None, "assistant", "First?"), (8, 5, "user", "x" * 200_000 + "."), (8, 5, "user", "x" * 200_000 + "."),
        (9, 3, "", "No role."), (9, 9, "system", "Late."), (10, -4, "assistant", "."), (10, 4, "assistant", "."),
    ]
    assert run(spark, tmp_path, rows, clashing) == by_hand(rows)


def test_conversation_whose_rows_all_go(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, tmp_path, [(conv, 0, "user", "Gone.")]) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_long_conversation_is_cut_between_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"line {rng.randint(0, 3000)}" + rng.choice([".", "", "!"])) for t in range(3000)]
    rows += [(c, t, "user", "Hello.") for c in range(2, 30) for t in range(2)]
    found, want = run(spark, tmp_path, rows), None
    short = {c: v for c, v in found.items() if c != 1}
    assert short == by_hand([r for r in rows if r[0] != 1])
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(60_000)
    try:
        want = by_hand([r for r in rows if r[0] == 1][:900])
    finally:
        sys.setrecursionlimit(limit)
    assert run(spark, tmp_path, [r for r in rows if r[0] == 1][:900]) == want
    assert len(found[1][6]) >= 2000


def test_nodes_are_shared_and_equal_fresh_ones():
    rng = random.Random(5)
    signatures = sorted("".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 12))) for _ in range(500))
    shared = conversations.Automaton()
    for backward in signatures:
        fresh = conversations.Automaton()
        fresh.read(backward)
        shared.read(backward)
        assert shared.best() == fresh.best()


def test_repaired_rows_have_the_grammar_and_the_digest(spark, tmp_path):
    rows = random_rows(60, 9)
    given = spark.createDataFrame(rows, SCHEMA)
    hurt = conversations.damaged(given.coalesce(1))
    repairs = conversations.repair(hurt)
    out = {}
    for conv, place, role, text in sorted(map(tuple, conversations.repaired(hurt, repairs).collect())):
        out.setdefault(conv, []).append((role, text))
    want = by_hand(rows)
    for conv, expected in want.items():
        own = out.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == expected[-1]


@pytest.mark.parametrize("letters, cost, audit", [("ua", 0, "KK"), ("a", 2, "IK"), ("u", 2, "KI"), ("x", 3, "D"), ("suaU", 3, "KKKD"), ("saua", 2, "KIKKK"), ("aa", 2, "RK")])
def test_small_repairs(letters, cost, audit):
    automaton = conversations.Automaton()
    automaton.read(letters[::-1])
    found, edits = automaton.best()
    assert (found, edits.translate(str.maketrans(*conversations.AUDIT))) == (cost, audit)
