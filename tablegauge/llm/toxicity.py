"""Toxicity: a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel of two words counts the character sequences that both contain, each weighted
down by the gaps it has, and is larger if the words begin and end alike; so words with
inserted characters stay alike, and words that merely contain another are less so.
Landmarks are the words that tell toxic sentences from clean ones, and the words of clean
sentences that are most like them. The machine learns from labelled sentences: a sentence
is as toxic as its most toxic word, a text as its most toxic sentence.
"""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.linear import FOLD, SAMPLE, calibrate, held_out, hinge_fit, labelled_sample, logistic
from tablegauge.llm.shipping import ship

#: Telling words that become landmarks, and clean words like them that do.
LANDMARKS, CONFUSABLE = 96, 48
ORDER, DECAY = 3, 0.95
#: Share of the kernel that is left for each end at which two words differ.
ENDS = 0.5
#: Kernel values are raised to this power, which keeps them a kernel; below `FLOOR` they are 0.
POWER, FLOOR = 3, 0.4
#: A word is telling if it is so many times as frequent in toxic texts.
TELLING = 8.0
#: Characters of a token that are compared at once, if no landmark is longer; longer tokens are compared window by window.
WIDTH = 24
SKIPS, SKIP = 256, 3
#: Share of a landmark's skip pairs that a word must have to be compared at all.
SHARED = 0.4
#: Examples that a clean word gives, at most: one for each clean text that has it.
REPEATS = 10
CACHE = 200_000
#: Letters put into telling words of the examples, at most.
INSERTED = 3

_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?]+\s|\n")


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    a: float
    b: float


def sentences(text: str) -> list[set[str]]:
    """Lower-case words of each sentence; letters set apart by single spaces count as a word too."""
    text = text.lower()
    return [*(set(part.split()) for part in _SENTENCE.split(text)), *({run} for run in runs(text))]


def runs(text: str) -> set[str]:
    """Words whose letters are set apart by single spaces, also less a letter that stood before or after them."""
    found = {run.replace(" ", "").replace("\t", "") for run in _SPACED.findall(text)}
    return {part for run in found for part in (run, run[1:], run[:-1], run[1:-1])}


def tokens(text: str) -> set[str]:
    """The words of all sentences."""
    text = text.lower()
    return {*text.split(), *runs(text)}


def letters(token: str) -> str:
    """The letters of a token: signs put between them do not hide a word."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def _coded(words: list[str], width: int) -> np.ndarray:
    """Code points, one row a word, padded with 0."""
    joined = np.array(words, dtype=f"<U{width}")
    return joined.view(np.uint32).reshape(len(words), width)


def _skips(codes: np.ndarray) -> np.ndarray:
    """Which pairs of characters up to `SKIP` apart each word has, hashed to `SKIPS` bits."""
    out = np.zeros((len(codes), SKIPS), np.float32)
    rows = np.arange(len(codes))
    for gap in range(1, SKIP + 1):
        for at in range(codes.shape[1] - gap):
            x, y = codes[:, at], codes[:, at + gap]
            real = np.flatnonzero(y)
            out[rows[real], ((x[real] * np.uint32(0x9E3779B1) + y[real] * np.uint32(0x85EBCA6B)) >> np.uint32(24))] = 1
    return out


def subsequence_kernel(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted kernel of sequences of `order` characters, row by row of two code arrays."""
    n, width, other = len(x), x.shape[1], y.shape[1]
    met = (np.ascontiguousarray(x.T)[:, None] == np.ascontiguousarray(y.T)[None]) & (x.T > 0)[:, None]
    met = met.astype(np.float32) * np.float32(decay * decay)
    fade, total = np.float32(decay), np.zeros(n, np.float32)
    # below[i, j]: sequences one shorter within the first i and j characters, faded to there.
    below = np.ones((width + 1, other + 1, n), np.float32)
    for k in range(order):
        last = k == order - 1
        above = None if last else np.zeros((width + 1, other + 1, n), np.float32)
        for i in range(1, width + 1):
            now = met[i - 1] * below[i - 1, :other]
            if last:
                total += now.sum(axis=0)
                continue
            for j in range(1, other):
                now[j] += fade * now[j - 1]
            above[i, 1:] = fade * above[i - 1, 1:] + now
        below = above
    return total


def _self(codes: np.ndarray) -> np.ndarray:
    return subsequence_kernel(codes, codes)


class Matcher:
    """Kernel values of words with a fixed list of landmarks."""

    def __init__(self, landmarks: tuple[str, ...]) -> None:
        longest = max(map(len, landmarks), default=0)
        self.width = max(WIDTH, 2 * longest)
        self.codes = _coded(list(landmarks), max(1, longest))
        self.lengths = (self.codes > 0).sum(axis=1)
        self.norms = np.sqrt(np.maximum(_self(self.codes), 1e-12))
        self.skips = _skips(self.codes)
        self.least = np.maximum(SHARED * self.skips.sum(axis=1), 1)

    def values(self, words: list[str]) -> np.ndarray:
        """One row for each word of at most `width` characters; the same function for landmarks and texts."""
        out = np.zeros((len(words), len(self.codes)), np.float32)
        codes = _coded(words, self.width)
        rows, marks = np.nonzero(_skips(codes) @ self.skips.T >= self.least)
        if not len(rows):
            return out
        lengths, marked = (codes > 0).sum(axis=1), self.lengths
        order = np.argsort(lengths[rows] * 100 + marked[marks], kind="stable")
        rows, marks, cross = rows[order], marks[order], np.zeros(len(order))
        for lo in range(0, len(order), 2048):
            word, mark = rows[lo : lo + 2048], marks[lo : lo + 2048]
            cross[lo : lo + 2048] = subsequence_kernel(codes[word, : lengths[word].max()], self.codes[mark, : marked[mark].max()])
        cross /= self.norms[marks]
        for at, end in ((0, 0), (lengths - 1, marked - 1)):
            mine, theirs = codes[np.arange(len(codes)), at], self.codes[np.arange(len(marked)), end]
            cross *= np.where(mine[rows] == theirs[marks], 1.0, ENDS)
        # A word's own kernel is at least that of its runs of characters, so few words need it.
        least = np.sqrt(np.maximum(lengths[rows] - ORDER + 1, 1) * DECAY ** (2 * ORDER))
        close = np.flatnonzero(cross >= FLOOR * least)
        some, back = np.unique(rows[close], return_inverse=True)
        own = np.ones(len(some))
        for lo in range(0, len(some), 2048):
            word = some[lo : lo + 2048]
            own[lo : lo + 2048] = _self(codes[word, : lengths[word].max()])
        alike = cross[close] / np.sqrt(np.maximum(own[back], 1e-12))
        out[rows[close], marks[close]] = np.where(alike < FLOOR, 0, alike**POWER)
        return out

    def windows(self, word: str) -> list[str]:
        """A word, or of one longer than `width` windows that overlap by half."""
        half = self.width // 2
        return [word[at : at + self.width] for at in range(0, max(1, len(word) - half), half)]


class Words:
    """Margins of tokens, computed for many at once and remembered."""

    def __init__(self, model: "Model") -> None:
        self.model, self.matcher = model, Matcher(model.landmarks)
        self.known: dict[str, float] = {}

    def learn(self, seen: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = {t: letters(t) for t in seen if t not in self.known}
        words = [w for w in set(new.values()) if w not in self.known and len(w) >= ORDER]
        best = dict.fromkeys(words, 0.0)
        pieces, owner = [], []
        for word in words:
            found = self.matcher.windows(word) if len(word) > self.matcher.width else [word]
            pieces += found
            owner += [word] * len(found)
        for lo in range(0, len(pieces), 20_000):
            margins = self.matcher.values(pieces[lo : lo + 20_000]) @ self.model.weights
            for k in np.flatnonzero(margins > 0).tolist():
                best[owner[lo + k]] = max(best[owner[lo + k]], float(margins[k]))
        self.known.update(best)
        for token, word in new.items():
            self.known[token] = self.known.get(word, 0.0)

    def margins(self, texts: list[set[str]]) -> np.ndarray:
        """Of each text the largest margin of its words; 0 stands for words like no landmark."""
        self.learn(set().union(*texts))
        return np.array([max(map(self.known.__getitem__, text), default=0.0) for text in texts]) + self.model.bias


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[" ".join(sorted(s)) for s in sentences(text or "")] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], names=["y", "sentences"])


def telling_words(texts: list[list[str]], y: np.ndarray) -> list[str]:
    """Words far more frequent in toxic texts, the best first."""
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - ones)
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, y):
        (toxic if label else clean).update(words_of(text))

    def ratio(word: str) -> float:
        return float(np.log((toxic[word] + 0.5) / (ones + 1)) - np.log((clean[word] + 0.5) / (zeros + 1)))

    found = [w for w in toxic if toxic[w] > 2 and len(w) >= ORDER and ratio(w) > np.log(TELLING)]
    return sorted(found, key=lambda w: (-ratio(w) * np.sqrt(toxic[w]), w))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> Model:
    """A model from at most `rows` labelled texts; without two classes it scores their share."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col), F.col(text).alias("text"))
    sample = labelled_sample(given, labels.select(id_col, label), label, id_col, rows).select("y", "text")
    table = sample.mapInArrow(_sentences, "y int, sentences array<string>").toArrow()
    rows_found = sorted(zip(table.column("y").to_pylist(), table.column("sentences").to_pylist()))
    return learned([text for _, text in rows_found], np.array([label for label, _ in rows_found], np.int64))


def disguised(word: str, count: int, seed: str) -> str:
    """`word` with `count` letters put between its own, the same ones for the same seed."""
    drawn = zlib.crc32(f"{word} {count} {seed}".encode())
    for _ in range(count):
        at, drawn = 1 + drawn % (len(word) - 1), drawn // (len(word) - 1)
        word, drawn = word[:at] + chr(ord("a") + drawn % 26) + word[at:], drawn // 26
    return word


def words_of(text: list[str]) -> set[str]:
    return {letters(t) for sentence in text for t in sentence.split()}


def learned(texts: list[list[str]], y: np.ndarray) -> Model:
    """A model from the sentences of texts and their labels."""
    check = np.arange(len(y)) % FOLD == 0
    learn = np.flatnonzero(~check)
    telling = telling_words([texts[i] for i in learn], y[learn])[:LANDMARKS]
    if not telling:
        return Model((), np.zeros(0), 0.0, *calibrate(np.zeros(len(y)), y))
    insults = set(telling)
    # Words of clean sentences are clean. Those like a telling word become landmarks too.
    often = Counter(w for i in learn if not y[i] for w in words_of(texts[i]) if len(w) >= ORDER and w not in insults)
    clean = sorted(often)
    first = Matcher(tuple(telling))
    pieces = [(window, w) for w in clean for window in first.windows(w)]
    near = np.concatenate(
        [first.values([p for p, _ in pieces[lo : lo + 20_000]]).max(axis=1) for lo in range(0, len(pieces), 20_000)] or [np.zeros(0)]
    )
    order = np.argsort(-near, kind="stable")
    alike = list(dict.fromkeys(pieces[i][0] for i in order[: 2 * CONFUSABLE] if near[i] > 0))[:CONFUSABLE]
    landmarks = tuple(telling + alike)
    matcher = Matcher(landmarks)
    gram = matcher.values(list(landmarks)).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    # Nyström: directions that the landmarks hardly span would only amplify noise.
    root = vectors @ np.diag(np.where(values > 1e-2, np.maximum(values, 1e-2) ** -0.5, 0)) @ vectors.T

    # What makes a sentence toxic is its telling word, also with letters put into it.
    bad = {disguised(w, count, f"{i}") for i in learn if y[i] for w in words_of(texts[i]) & insults for count in range(INSERTED + 1)}
    bad = sorted(w for w in bad if len(w) <= matcher.width)
    good = [pieces[i][0] for i in np.flatnonzero(near > 0) for _ in range(min(often[pieces[i][1]], REPEATS))]
    features = np.vstack([matcher.values(bad), matcher.values(good), np.zeros((1, len(landmarks)))])
    signs = np.array([1] * len(bad) + [-1] * (len(good) + 1))
    mapped = np.hstack([features @ root, np.ones((len(features), 1))])
    weights = hinge_fit([(slice(None), row) for row in mapped], signs, mapped.shape[1], epochs=20)
    model = Model(landmarks, root @ weights[:-1], float(weights[-1]), 1.0, 0.0)

    scorer = Words(model)
    held = [i for i in np.flatnonzero(check)]
    judged = [({t for s in texts[i] for t in s.split()}, int(y[i])) for i in held]
    for count in range(1, INSERTED + 1):
        for i in held:
            if y[i]:
                hidden = {disguised(w, count, f"{i}") for w in words_of(texts[i]) & insults}
                judged += [(hidden, 1)] if hidden else []
    margins = np.concatenate([scorer.margins([t for t, _ in judged[lo : lo + 500]]) for lo in range(0, len(judged), 500)])
    a, b = calibrate(margins, np.array([label for _, label in judged]))
    return Model(landmarks, model.weights, model.bias, a, b)


def _scorer(model: Model) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                margins = words.margins([tokens(text or "") for text in part.column("text").to_pylist()])
                scores = logistic(margins, model.a, model.b)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return work


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score in [0, 1]; NULL and empty texts are scored too.

    Rows are independent: those that repeat an id or are equal are scored each. Further
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(_scorer(model), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score")
