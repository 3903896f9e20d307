"""Encoding and decoding against the tokenizers library."""

import random

import pytest

from tablegauge.llm import bpe
from tests.llm.awkward import DOC, ROWS, clashing

SPICE = ["'s", "<|endoftext|>", "<|startoftext|>", " ", "\n", "Σ", "ΑΣ ", "é", "é", "́", "İ", "ﬁ", "1", "२", "th", "ing", "THE",
         "!", "--", "😀", "\x85", "\x1c", "​", "漢字", "'RE", "<|", "\U00016ea0", "Ᲊ", "\U000105c0", "﷐"]


@pytest.fixture(scope="module")
def theirs():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def ids_of(theirs, text):
    return theirs.encode(text or "", add_special_tokens=False).ids


def test_random_strings(theirs):
    rng, words = random.Random(4), bpe.vocabulary()
    for _ in range(8000):
        text = "".join(rng.choice(SPICE) for _ in range(rng.randint(0, 25)))
        assert words.encode(text).tolist() == ids_of(theirs, text), repr(text)


def test_every_character(theirs):
    words = bpe.vocabulary()
    text = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    for a in range(0, len(text), 1000):
        some = text[a : a + 1000]
        assert [words.encode(t).tolist() for t in some] == [e.ids for e in theirs.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("length", [1, 2, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 4000])
def test_scan_and_heap_merge_alike(theirs, length):
    rng, words = random.Random(length), bpe.vocabulary()
    text = "".join(rng.choice("abcdeinthxyz") for _ in range(length))
    parts = [words.inner[b] for b in text.encode()[:-1]] + [words.last[ord(text[-1])]]
    assert bpe.scanned(parts[:], words.merges) == bpe.heaped(parts[:], words.merges) == ids_of(theirs, text)
    assert bpe.scanned([words.inner[97]] * length, words.merges) == bpe.heaped([words.inner[97]] * length, words.merges)


def test_slices_do_not_show(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    text = "The café é <|endoftext|> it's  ́ Σας\n\n 'll 12 x<|startoftext|>" * 5
    assert bpe.vocabulary().encode(text).tolist() == ids_of(theirs, text)


def test_rows_of_all_kinds(spark, theirs):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    encoded = bpe.encode(docs)
    assert set(encoded.columns) == (set(docs.columns) - {"text"}) | {"ids"}
    found = bpe.decode(encoded).select("doc_id", "decoded", "kept").collect()
    ids = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    assert ids == {(r[0], tuple(ids_of(theirs, r[1]))) for r in ROWS}
    want = sorted((str(r[0]), theirs.decode(ids_of(theirs, r[1]), skip_special_tokens=False)) for r in ROWS)
    assert sorted((str(r.doc_id), r.decoded) for r in found) == want
    assert {r.kept for r in found} == {"own kept"}


def test_query_gives_digests_of_ids_and_text(spark, folder, theirs):
    import hashlib

    from tablegauge.llm.queries import QUERIES

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = ids_of(theirs, text)
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    found = QUERIES["op12_bpe"](spark, folder(documents=(ROWS, DOC))).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_empty_table_null_and_unknown_ids(spark):
    assert bpe.encode(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6, None, -1, 512])], "n int, ids array<int>")
    names = bpe.vocabulary().names
    found = {r.n: r.decoded for r in bpe.decode(rows).collect()}
    assert found == {1: "", 2: "", 3: f"{names[320].as_py()} {names[512].as_py()}"}


def test_decoding_slices_do_not_show(spark, monkeypatch):
    batch = bpe.pa.RecordBatch.from_arrays(
        [bpe.pa.array([1, 2, 3, 4]), bpe.pa.array([[320, 321], None, [], [512] * 5], bpe.pa.list_(bpe.pa.int32()))], names=["c0", "__ids"]
    )
    whole = [r for b in bpe._decoded(bpe.VOCABULARY)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(bpe, "ROWS_OF", 1)
    assert [r for b in bpe._decoded(bpe.VOCABULARY)(iter([batch])) for r in b.to_pylist()] == whole
