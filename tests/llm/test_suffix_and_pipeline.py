"""Repeated strings against brute force; the pipeline stage by stage."""

import hashlib
import os
import random

import pytest

import corpus_pipeline
from tablegauge.llm.queries import QUERIES
from tablegauge.llm.suffix_dedup import suffix_dedup

from .awkward import CLASHES, DOC, ROWS, clashing
from .test_near_dedup import classes

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept digest) per id; ids are distinct."""
    seen, out = set(), {}
    for ident, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            word = hashlib.blake2b(data[at : at + 100], digest_size=12).digest()
            if word in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(word)
        runs = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()
        out[ident] = (len(data), sum(gone), runs, kept)
    return out


def found(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(df, **options).collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_suffix_dedup"](spark, FOLDER).collect()} == brute(rows)


@pytest.mark.parametrize("crowd", [100_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_repetitive_texts(spark, crowd, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab") for _ in range(300))
    middles = ["x" * 350, "Shti " * 80, "é" * 60, "", "\0" * 130]
    rows = [
        (i, base[rng.randrange(50) : rng.randrange(150, 300)] + rng.choice(middles) + base[rng.randrange(100) :]) for i in range(50)
    ]
    rows += [(100, None), (101, ""), (102, "a" * 99), (103, "a" * 100), (104, "a" * 101), (105, base), (106, base), (None, base + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, crowd=crowd) == brute(rows)


def test_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    rows = suffix_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.n_removed)
    size = len(ROWS[0][1])
    assert by_id[1] == [0] and by_id[2] == [size, size] and by_id[4] == [0] and max(by_id[9]) > 100_000
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_stages_take_awkward_rows_and_keep_columns(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            result = stage(spark, given, FOLDER)
            rows = result.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert result.columns == docs.columns, name
                assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c != "doc_id")
    kept = corpus_pipeline.exact_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 6, None, 8, 9, 10], key=str)
    near = corpus_pipeline.near_copies(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in near) == [1, 3, 4, 8, 10]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_each_stage_does_its_work(spark, tmp_path):
    docs, sizes = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    steps = dict(corpus_pipeline.STAGES)
    for place, name in enumerate(("quality rules", "exact dedup", "MinHash near-dedup", "mixing sources")):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        steps[name](spark, docs, FOLDER).write.parquet(f"{tmp_path}/{place}")
        docs = spark.read.parquet(f"{tmp_path}/{place}")
        after = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
        sizes.append(len(after))
        if name == "quality rules":
            verdicts = {r.doc_id: r.kept for r in QUERIES["op5_quality_rules"](spark, FOLDER).collect()}
            assert after == sorted(r for r in before if verdicts[r[0]])
        elif name == "exact dedup":
            assert len({" ".join(t.split(" ")) for _, t in after}) == len(after)
            assert {t for _, t in after} == {t for _, t in before}
        elif name == "MinHash near-dedup":
            assert [i for i, _ in after] == sorted({c for _, c in classes(before)})
        else:
            counts = {}
            for ident, _ in after:
                counts[ident] = counts.get(ident, 0) + 1
            assert set(counts.values()) <= {1, 2} and set(counts) <= {i for i, _ in before}
    pieces = steps["best-fit packing"](spark, docs, FOLDER)
    assert pieces.filter("piece = 0").count() == sizes[-1]
