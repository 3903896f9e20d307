"""Mixing against targets worked out by hand, packing against the tokenizer and the bound."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tablegauge.llm import packing as P
from tablegauge.llm.mixing import mix_sources, targets, training_order
from tablegauge.llm.queries import mixed_sources

from .awkward import DOC, PLAIN, ROWS, clashing


def filled(sizes, demand=1.5, repeats=2, weights=(5, 2, 1)):
    """Targets by repeated sharing: sources above their cap get it, the rest share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    cap, open_, left, found = {s: repeats * sizes[s] for s in order}, set(order), demand * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap[s]}
        if not full:
            return found | {s: weight[s] * level for s in open_}
        for s in full:
            found[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return found


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, "é": 30, None: 7}, {"x": 5}, {"a": 1, "b": 1, "c": 10_000}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(filled(sizes))


def test_taken_words_meet_targets_and_passes_follow_the_schedule(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), f"s{min(i % 7, 3)}") for i in range(700)]
    mix = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mix.collect()
    assert len(found) == 700 and all(r.taken <= 2 * r.size for r in found)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: int(t) for s, t in target.items()} == dict(taken)
    assert sorted(map(str, mix.collect())) == sorted(map(str, found))
    order = training_order(mix).collect()
    assert [r.time for r in order] == sorted(r.time for r in order) and all(0 <= r.time <= 1 for r in order)
    assert sum(r.words for r in order) == sum(taken.values())
    # Heavy sources come early: their words' mean time lies before the middle, light ones' after.
    mean = {s: np.average([r.time for r in order if r.source == s], weights=[r.words for r in order if r.source == s]) for s in taken}
    assert mean["s0"] < 0.5 < mean["s2"] and mean["s1"] == pytest.approx(0.5, abs=0.05)


def test_the_query_gives_its_rows_in_training_order(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i % 4}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = mixed_sources(spark, str(tmp_path)).collect()
    first = list(dict.fromkeys(r.doc_id for r in training_order(mix_sources(docs)).collect()))
    assert len(found) == 500 and [r.doc_id for r in found][: len(first)] == first
    assert all(r.taken == 0 and r.first_due is None for r in found[len(first) :])


def test_the_pipeline_mixes_whole_texts(spark):
    rows = [(i, "\n".join(["w"] * (3 + i * 7 % 40)), f"s{i % 3}", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    target = {r.source: r.target for r in mix_sources(docs).collect()}
    taken, texts = defaultdict(int), {i: text for i, text, *_ in rows}
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        assert r.text == texts[r.doc_id] and r.n_chars == 2
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 43 / 2 + 1 for s, t in target.items())


def test_mix_of_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    rows = mix_sources(docs, carry=("n_words", "kept")).collect()
    assert len(rows) == len(ROWS) and {r.n_words for r in rows} == {"own n_words"}
    assert all(r.taken == 0 and r.size == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert mix_sources(docs.limit(0)).count() == 0


def packed(rows):
    """Checks that sequences have no gaps; gives their number."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return len(by_sequence)


def test_pieces_and_sequences_of_awkward_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    rows = P.pack(P.pieces(docs)).collect()
    packed(rows)
    expected = []
    for doc_id, text, *_ in ROWS:
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        starts = P.cut(len(ids))
        expected += [
            (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))
        ]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r.length == P.CAPACITY or r.piece == 0 for r in rows)
    assert P.pack(P.pieces(docs.limit(0))).count() == 0


def test_ids_are_the_librarys_with_special_strings(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    slow, rng = Tokenizer.from_file(public_tokenizers.path(P.ADDED)), random.Random(6)
    spice = ["<|endoftext|>", "<|endof", "|>", " ", "  ", "\n", "a", "the", "'s", "é", "😀", "12", "!", "\t", "ß", "\x00"]
    texts = ["".join(rng.choice(spice) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    fast = P.encoder()
    for text, theirs in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert fast.encode(text, allowed_special="all") == theirs.ids, repr(text)
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert P.pieces(docs, with_ids=True).first().ids == [*slow.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]


def test_packing_comes_close_to_the_bound(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.clip(rng.lognormal(5.6, 1.0, 6000), 1, 1024)]
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    assert packed(P.pack(parts.repartition(7)).collect()) <= math.ceil(sum(lengths) / 1024) * 1.01 + 1


def test_underfull_bins_meet_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "ITEMS", 40)
    parts = spark.createDataFrame([(i, 300 + i % 400) for i in range(900)], "id long, length long")
    rows = P.pack(parts).collect()
    best = {r.id: r for r in rows}
    assert len(best) == 900
    few = packed(rows)
    monkeypatch.setattr(P, "ITEMS", 16_000)
    assert few <= packed(P.pack(parts).collect()) * 1.1


def test_best_fit_fills_the_fullest_bin_that_fits():
    bins, offsets, _ = P.best_fit(np.arange(5), np.array([700, 600, 300, 320, 100]), 1024)
    assert bins[3] == bins[0] and bins[2] == bins[1] and bins[4] == bins[1]
    assert offsets.tolist() == [0, 0, 600, 700, 900]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, PLAIN), (2, "short"), (3, None)], "doc_id long, text string")
    given = P.pieces(docs, with_ids=True)
    whole = P.sequences(P.pack(given)).collect()
    assert sorted(x for r in whole for x in r.ids) == sorted(x for r in given.collect() for x in r.ids)


def test_words_of_contracts():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b  c\n") == ["a b", " c"]
