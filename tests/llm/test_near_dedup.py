"""Near duplicates against all pairs, and the sketch against what it estimates."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

from tablegauge.llm import near_dedup as nd
from tablegauge.llm.queries import QUERIES

from .awkward import DOC, ROWS, clashing

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def classes(rows):
    """Smallest id per class from all pairs; rows are (id, text)."""
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                up[root(i)] = root(j)
    members = {}
    for i, (ident, _) in enumerate(rows):
        members.setdefault(root(i), []).append(ident)
    return sorted((ident, min(m)) for m in members.values() for ident in m)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_near_dedup"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_a_crowd_of_near_copies_loses_no_link(spark):
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(120)]
    rows = []
    for ident in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((ident, " ".join(words)))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes(rows)


def repeating(ident):
    """A text, and the same with a run of words said twenty times: their sets have a Jaccard similarity just over 0.8."""
    text = " ".join(f"a{ident}x{k}" for k in range(204))
    return text, text + " " + " ".join([f"b{ident}x{k}" for k in range(40)] * 20)


def test_repeated_shingles_hide_no_link(spark):
    rows = [(2 * k + side, text) for k in range(40) for side, text in enumerate(repeating(k))]
    expected = classes(rows)
    assert expected == [(i, i // 2 * 2) for i in range(80)]
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == expected


def test_block_comparison_sees_sets():
    for k in range(10):
        batch = pa.RecordBatch.from_arrays([pa.array(repeating(k))], names=["text"])
        x, y = (np.frombuffer(r.as_py(), np.uint16) for r in next(nd._sketches(iter([batch]))).column("registers"))
        assert (x == y).mean() >= nd.LIKELY


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    weights = rng.integers(1, 5, 300).astype(float)
    a, b = slice(0, 250), slice(50, 300)
    same = (nd.prob_minhash(elements[a], weights[a], 4000) == nd.prob_minhash(elements[b], weights[b], 4000)).mean()
    wa, wb = np.zeros(300), np.zeros(300)
    wa[a], wb[b] = weights[a] / weights[a].sum(), weights[b] / weights[b].sum()
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(50, 250))
    assert abs(same - exact) < 0.04
    assert (nd.prob_minhash(elements[:1], weights[:1]) == elements[0]).all()


def test_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    rows = nd.near_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    found = sorted(((r.doc_id, r.class_id) for r in rows), key=str)
    assert found == sorted(
        [(1, 1), (2, 1), (2, 1), (3, 1), (3, 3), (4, 4), (5, 4), (6, 4), (None, 1), (None, 4), (8, 8), (9, 8), (10, 10)], key=str
    )
    assert sum(r.kept for r in rows) == 5
    assert nd.near_dedup(docs.limit(0)).count() == 0
