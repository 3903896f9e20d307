"""Ranked search against a score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import lexical
from tablegauge.llm.words import stored
from tests.llm.awkward import DOC, ROWS, clashing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    """All scores of all documents by the contract's formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k, change=lambda df: df, parts=3):
    frame = change(spark.createDataFrame(docs, "doc_id long, text string")).repartition(parts)
    index = stored(lexical.build_index(frame), "index")
    asked = change(spark.createDataFrame(items, "item_id long, text string"))
    return sorted(map(tuple, lexical.search(index, asked, k).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(vocabulary, k=int(rng.paretovariate(0.8)) + 3))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_all_scores(spark, monkeypatch, k):
    docs = corpus(900, k)
    rng = random.Random(k)
    items = [(i, " ".join(f"T{int(rng.paretovariate(0.5))}" for _ in range(12))) for i in range(20)]
    assert searched(spark, docs, items, k) == by_hand(docs, items, k)


def test_blocks_and_stretches_do_not_show(monkeypatch):
    docs = corpus(3000, 3)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "STRETCH", 100)
    numbers, found = lexical._Numbers(), []
    for _, text in docs:
        own = lexical.array("i")
        for some in lexical.terms(text.encode()):
            own.extend(map(numbers.__getitem__, some))
        found.append(own)
    rows = lexical.segment_rows(5, [i for i, _ in docs], found, numbers).to_pylist()
    lengths = np.array(rows[0]["lengths"])
    n_docs, n_terms = len(docs), int(lengths.sum())
    lists = {r["term"].decode(): lexical.Postings(r, n_docs, n_terms) for r in rows[1:]}
    rng, skipped = random.Random(1), 0
    for _ in range(30):
        words = {f"t{int(rng.paretovariate(0.4))}" for _ in range(8)}
        for p in lists.values():
            p.known.clear()
        wanted = []
        for word in words & set(lists):
            df = sum(len(lists[word].block(b)[0]) for b in range(len(lists[word].ends)))
            lists[word].known.clear()
            wanted.append((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))), lists[word]))
        got, scores = lexical.best(wanted, lengths, 10, n_docs, n_terms)
        want = by_hand(docs, [(0, " ".join(words))], 10)
        assert sorted(zip(got.tolist(), scores.tolist())) == sorted((d, s) for _, _, d, s in want)
        skipped += sum(len(p.ends) - len(p.known) for _, p in wanted)
    assert skipped > 100  # blocks that were never unpacked


def test_segments_and_query_blocks_do_not_show(spark, monkeypatch):
    docs, items = corpus(300, 8), [(i, f"t{i} t1 t2") for i in range(40)]
    monkeypatch.setattr(lexical, "QUERIES", 3)
    assert searched(spark, docs, items, 5, parts=7) == by_hand(docs, items, 5)


def test_awkward_rows(spark):
    docs = [(r[0], r[1]) for r in ROWS] + [(50, "\x00ÄÖ tie"), (51, "ÄÖ tie"), (52, "äö TIE tie")] + [(60 + i, "same words here") for i in range(9)]
    items = [(1, "word7 ward7 w5x5"), (1, "tie ÄÖ"), (2, None), (3, ""), (None, "same same here"), (4, "unknownterm"), (5, "é tail text")]
    assert searched(spark, docs, items, 4, clashing) == by_hand(docs, items, 4)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == []
    assert searched(spark, [(1, None), (2, "  ")], [(1, "a")], 5) == []
    assert searched(spark, [(1, "a")], [], 5) == []


def test_numbers_in_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**45, 0, 5])
    data, sizes = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist() and sizes.sum() == len(data)
    assert lexical.unpacked(np.zeros(0, np.uint8)).tolist() == []
