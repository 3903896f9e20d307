"""Classifiers: accuracy on held-out rows, kernels against their definition, awkward rows."""

import os
import re
import struct
import textwrap
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablegauge.llm import license_scan, quality_model, toxicity
from tablegauge.llm.linear import hinge_fit
from tablegauge.llm.queries import QUERIES

from .awkward import DOC, ROWS, clashing

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LABEL = "doc_id long, quality int, toxic int"


@tables
@pytest.mark.parametrize("name, label, least", [("op6_quality_classifier", "quality", 0.97), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert found.filter("score < 0 or score > 1 or score is null").isEmpty()
    assert found.filter("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").isEmpty()


@pytest.mark.parametrize("model", [quality_model, toxicity])
@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(1, 1, 1), (2, 1, 1), (8, 0, 0), (9, 0, 0), (10, 0, 0), (1, 0, 0)]])
def test_awkward_rows_and_labels(spark, model, labels):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    fitted = model.fit(docs, spark.createDataFrame(labels, LABEL))
    rows = model.score(docs, fitted).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert model.score(docs.limit(0), fitted).count() == 0


def test_inserted_characters_and_gaps_do_not_hide_an_insult(spark):
    rng = np.random.default_rng(1)
    plain = ["river", "garden", "window", "letter", "morning", "engine", "carpet", "orange"]
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[rng.integers(30)] = "blorkhead"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    fitted = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABEL))
    tried = ["a blorkhead here", "a b-l-o-r-k-h-e-a-d here", "a b l o r k h e a d here", "BLORKxHEAD", "the garden window", ""]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), fitted).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in rows] == [True, True, True, True, False, False]


PLAIN_WORDS = ["river", "garden", "window", "letter", "morning", "engine", "carpet", "orange"]
ORDINARY = ["closer", "scumble", "mormon", "succumb", "idiomatic", "stupor", "motion", "crown"]
INSULTS = ["blorkhead", "stupid", "moron", "idiot", "loser", "scum"]


@pytest.fixture(scope="module")
def insult_model():
    """Learned from sentences with insults, and clean ones with ordinary words that contain or resemble them."""
    rng = np.random.default_rng(1)
    texts, y = [], np.array([int(i < 180) for i in range(720)])
    for i in range(720):
        words = list(rng.choice(PLAIN_WORDS, 30))
        words[rng.integers(30)] = INSULTS[i // 4 % len(INSULTS)] if y[i] else ORDINARY[i // 4 % len(ORDINARY)]
        texts.append([" ".join(sorted(set(words)))])
    return toxicity.learned(texts, y)


def scores(model, texts):
    return toxicity.logistic(toxicity.Words(model).margins([toxicity.tokens(t) for t in texts]), model.a, model.b)


def test_letters_put_in_do_not_hide_an_insult(insult_model):
    tried = [*INSULTS, "BLORKxHEAD", "blorkxhead", "stuxpid", "morxon", "idixot", "ixdiot", "lozser", "bxlorkhqead", "sztupwid", "iwdizot",
             "b.l.o.r.k.head", "s t u p i d", "m-o-r-o-n"]
    found = scores(insult_model, [f"the garden {t} there" for t in tried])
    assert [t for t, s in zip(tried, found) if s < 0.5] == []


def test_ordinary_words_that_contain_an_insult_stay_clean(insult_model):
    texts = [*PLAIN_WORDS, *ORDINARY, "the garden window", "idle riot", "", "a closer mormon may succumb"]
    assert [(t, s) for t, s in zip(texts, scores(insult_model, texts)) if s >= 0.5] == []


def test_scores_equal_those_computed_word_by_word(insult_model):
    """Kernel, ends, power and floor from their definitions, for every word and landmark."""

    def weighted(word):
        found = {}
        for at in combinations(range(len(word)), toxicity.ORDER):
            key = "".join(word[i] for i in at)
            found[key] = found.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return found

    def dot(a, b):
        return sum(v * b[k] for k, v in a.items() if k in b)

    def kernel(x, y):
        a, b = weighted(x), weighted(y)
        value = dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))
        value *= (1 if x[0] == y[0] else toxicity.ENDS) * (1 if x[-1] == y[-1] else toxicity.ENDS)
        return value**toxicity.POWER if value >= toxicity.FLOOR else 0.0

    model = insult_model
    words = [*INSULTS, *ORDINARY, *PLAIN_WORDS, "stuxpid", "sztupwid", "losers", "morxon"]
    for word, got in zip(words, scores(model, words)):
        margin = max(0.0, float(np.dot([kernel(word, mark) for mark in model.landmarks], model.weights))) + model.bias
        assert got == pytest.approx(float(toxicity.logistic(np.array([margin]), model.a, model.b)[0]), abs=1e-3), word
    gram = toxicity.Matcher(model.landmarks).values(list(model.landmarks))
    assert np.allclose(gram, gram.T, atol=1e-4)


def test_landmarks_and_tokens_of_any_length():
    long = "antidisestablishmentarianismus"
    y = np.array([int(i % 3 == 0) for i in range(90)])
    texts = [[f"river garden window {long if label else 'engine'} number{i}"] for i, label in enumerate(y)]
    model = toxicity.learned(texts, y)
    assert long in model.landmarks
    tried = [long, f"{long[:9]}x{long[9:]}", "q" * 1000, "engine"]
    assert [s >= 0.5 for s in scores(model, tried)] == [True, True, False, False]


def test_kernel_equals_its_definition():
    def weighted(word):
        found = {}
        for at in combinations(range(len(word)), toxicity.ORDER):
            key = "".join(word[i] for i in at)
            found[key] = found.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return found

    for x, y in (("idiot", "idixot"), ("loser", "closer"), ("abcabc", "acb"), ("ab", "abc"), ("été", "étété")):
        a, b = weighted(x), weighted(y)
        exact = sum(a[k] * b[k] for k in a if k in b)
        got = toxicity.subsequence_kernel(toxicity._coded([x], 8), toxicity._coded([y], 12))[0]
        assert got == pytest.approx(exact, rel=1e-5, abs=1e-9)


def test_hinge_model_separates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = np.where(x @ [2.0, -1.0, 0.5] > 0.3, 1, -1)
    rows = [(slice(None), np.append(r, 1.0)) for r in x]
    w = hinge_fit(rows, y, 4, cost=10, epochs=60)
    assert np.mean(np.sign(np.hstack([x, np.ones((300, 1))]) @ w) == y) > 0.97


@pytest.fixture(scope="module")
def licence_model(spark):
    texts = [(i, f"quiet paragraph number {i} about the weather and rivers in spring") for i in range(60)]
    return license_scan.fit(spark.createDataFrame(texts, "doc_id long, text string"))


def test_templates_are_recognised_and_like_words_are_not(spark, licence_model):
    rows = [(family, f"Intro line.\n\n{text}\nmore") for family, texts in license_scan.TEMPLATES.items() for text in texts]
    rows += [(license_scan.UNKNOWN, text) for text in license_scan.OTHERWISE]
    rows += [(license_scan.UNKNOWN, "He asked permission to use the copyright office.")]
    found = license_scan.scan(spark.createDataFrame(rows, "family string, text string"), licence_model).collect()
    for r in found:
        confirmed = {n.family for n in r.notices if n.confirmed}
        assert confirmed == ({r.family} if r.family != license_scan.UNKNOWN else set()), r.text
    assert all(n.paragraph == 2 for r in found if r.text.startswith("Intro") for n in r.notices)


def test_no_confirmable_paragraph_is_dropped(spark, licence_model):
    named = [("CC-BY-SA", "Available under CC-BY-SA 4.0."), ("CC-BY", "Licensed  under  CC  BY  4.0."), ("CC-BY-NC", "available under cc - by - nc 4.0")]
    found = license_scan.scan(spark.createDataFrame(named, "family string, text string"), licence_model).collect()
    assert all(len(r.notices) == 1 and r.notices[0].similarity >= license_scan.SIMILAR for r in found if r.family == "CC-BY-SA")
    assert [len(r.notices) for r in found] == [1, 1, 1]


def test_wrapped_templates_are_joined_and_fragments_are_not_confirmed(spark, licence_model):
    wrapped = [(family, "\n".join(textwrap.wrap(text, 40))) for family, texts in license_scan.TEMPLATES.items() for text in texts]
    for r in license_scan.scan(spark.createDataFrame(wrapped, "family string, text string"), licence_model).collect():
        assert {n.family for n in r.notices if n.confirmed} == {r.family}, r.text
    fragments = ["this list of conditions", "use this file", "All rights", "the terms of the", "as published by", "this work"]
    for r in license_scan.scan(spark.createDataFrame([(x,) for x in fragments], "text string"), licence_model).collect():
        assert not any(n.confirmed for n in r.notices), r.text


def test_notices_equal_a_plain_computation(spark, licence_model):
    templates = [(i, text) for i, texts in enumerate(license_scan.TEMPLATES.values()) for text in texts]

    def words_of(line):
        return re.findall(r"[a-z0-9]+", line.lower())

    def pairs_of(words):
        return set(zip(words, words[1:])) or {(w,) for w in words}

    def alike(template, pairs):
        shared, size = len(template & pairs), len(template)
        part = shared / len(pairs) if shared >= license_scan.CLEAR or shared >= license_scan.PART * size else 0.0
        return max(shared / size, part)

    def gram(n, *words):
        key = xxhash.xxh64_intdigest(struct.pack("<i", n), 42)
        for word in words:
            key = xxhash.xxh64_intdigest(word.encode(), key)
        return (key - (1 << 64) if key >> 63 else key) % license_scan.SIZE

    def judged(words):
        grams = {gram(n, *words[i : i + n]) for n in license_scan.ORDERS for i in range(len(words) - n + 1)}
        flat = np.array(licence_model.weights).reshape(license_scan.SIZE, -1)
        margins = (np.array(licence_model.biases) + flat[sorted(grams)].sum(axis=0)) / licence_model.temperature
        p = np.exp(margins - margins.max())
        p /= p.sum()
        family = int(p.argmax()) if p.max() >= licence_model.floor else len(license_scan.TEMPLATES)
        return family, p.max()

    known = [(i, pairs_of(words_of(text))) for i, text in templates]

    def likeness(pairs):
        return max(alike(t, pairs) for _, t in known)

    def expected(text):
        lines = [words_of(line) for line in text.split("\n")]
        cued = [any(cue in line.lower() for cue in license_scan.CUES) for line in text.split("\n")]
        sure = [bool(w) and likeness(pairs_of(w)) >= license_scan.SIMILAR for w in lines]
        met = [len(w) > 1 and any(pairs_of(w) & t for _, t in known) for w in lines]
        found = [(i, 1, w) for i, w in enumerate(lines) if cued[i] or sure[i]]
        for i, (one, two) in enumerate(zip(lines, lines[1:])):
            if met[i] and met[i + 1] and not (sure[i] and sure[i + 1]) and likeness(pairs_of(one + two)) >= license_scan.SIMILAR:
                found.append((i, 2, one + two))
        for place, count, words in found:
            family, p = judged(words)
            own = [t for i, t in known if i == family]
            similarity = max((alike(t, pairs_of(words)) for t in own), default=0.0)
            rival = max(alike(t, pairs_of(words)) for i, t in known if i != family)
            held = max((len(t & pairs_of(words)) / len(t) for t in own), default=0.0)
            confirmed = similarity >= license_scan.SIMILAR and (held >= license_scan.SIMILAR or similarity > rival)
            yield place, count, license_scan.FAMILIES[family], p, similarity, confirmed

    rng = np.random.default_rng(11)
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.integers(1, 7)):
            words = templates[rng.integers(len(templates))][1].split(" ")
            start = rng.integers(0, len(words))
            part = words[start : start + rng.integers(1, 30)] if rng.random() < 0.6 else words
            kept = [w if rng.random() > 0.05 else "river" for w in part] + ["meadow"] * rng.integers(0, 3)
            lines += textwrap.wrap(" ".join(kept), int(rng.integers(20, 200)))
        texts.append(("\n".join(lines),))
    seen = 0
    for r in license_scan.scan(spark.createDataFrame(texts, "text string"), licence_model).collect():
        want = list(expected(r.text))
        seen += len(want)
        assert [(n.paragraph, n.lines, n.family, n.confirmed) for n in r.notices] == [(a, b, f, ok) for a, b, f, _, _, ok in want], r.text
        assert [(n.probability, n.similarity) for n in r.notices] == [pytest.approx((p, x), abs=1e-9) for *_, p, x, _ in want]
    assert seen > 300


def test_licences_of_awkward_rows(spark, licence_model):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    found = license_scan.scan(docs, licence_model)
    assert found.count() == len(ROWS) and found.filter(F.size("notices") > 0).isEmpty()
    assert license_scan.scan(docs.limit(0), licence_model).count() == 0
    assert license_scan.fit(docs.limit(0)).floor > 0
