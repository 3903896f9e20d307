"""Byte-pair encoding with word ends, and its inverse.

Short words are merged in a contiguous array of parts with the rank of every adjacent
pair beside it: the least rank is sought by a scan, its boundary deleted, and the two
ranks next to it looked up anew. Words are encoded once a worker and remembered.
"""

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablegauge.llm.shipping import ship

#: Name of the vocabulary among the public tokenizer files.
VOCABULARY = "word_bpe_49k.json"
#: Parts up to which a word is scanned; longer ones take a heap, for the same merges.
SHORT = 160
#: Words remembered by a worker, and characters up to which one is.
REMEMBERED, BRIEF = 150_000, 48
#: Characters of a text that are normalised and cut into words at a time.
SLICE = 1 << 20
#: Ids of the rows that leave a task, or are decoded, at a time.
ROWS_OF = 1 << 20

# The white space and the words of the vocabulary's own patterns.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

_loaded: dict[str, "Vocabulary"] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary(dict):
    """Ids of words, as a dictionary that encodes what it does not know yet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, special = content["model"], content["added_tokens"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {token["content"]: token["id"] for token in special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.fresh = _unassigned()
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.path, self.rules = path, None
        names = {i: token for token, i in ids.items()} | {i: token for token, i in self.special.items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        found = scanned(parts, self.merges) if len(parts) <= SHORT else heaped(parts, self.merges)
        if len(word) <= BRIEF:
            self[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Python's Unicode tables are older than the library's; a text with characters that
        they lack is cut into words by the library's own rules.
        """
        if text.isascii() or not self.fresh[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return WORD.findall(lowered(unicodedata.normalize("NFC", text)))
        self.rules = self.rules or Tokenizer.from_file(self.path)
        found = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, word)).decode("utf-8") for word, _ in found]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, slice by slice.

        A slice ends before a blank, where neither composition nor a word goes on.
        """
        if len(self) > REMEMBERED:
            self.clear()
        found, start = array("i"), 0
        while start < len(text):
            end = text.find(" ", start + SLICE) if start + SLICE < len(text) else -1
            end = end if end > 0 else len(text)
            for part in self.cut.split(text[start:end]) if "<|" in text else (text[start:end],):
                if part in self.special:
                    found.append(self.special[part])
                else:
                    found.extend(chain.from_iterable(map(self.__getitem__, self.words(part))))
            start = end
        return np.frombuffer(found, np.int32)


def _unassigned() -> np.ndarray:
    """Whether Python's Unicode tables lack a character, for every code point."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def lowered(text: str) -> str:
    """Lower case letter by letter; a sigma at the end of a word is like any other."""
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Vocabulary(public_tokenizers.path(name))
    return _loaded[name]


def scanned(parts: list[int], merges: dict) -> list[int]:
    """Merges of a short word: scan the ranks for the least, delete its boundary, refresh its neighbours."""
    none = (len(merges), -1)
    pairs = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least is none:
            break
        at = pairs.index(least)
        parts[at : at + 2] = [least[1]]
        del pairs[at]
        if at:
            pairs[at - 1] = merges.get((parts[at - 1], parts[at]), none)
        if at < len(pairs):
            pairs[at] = merges.get((parts[at], parts[at + 1]), none)
    return parts


def heaped(parts: list[int], merges: dict) -> list[int]:
    """The same merges for a long word: linked parts, and the pairs in a heap by rank and place."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(*merges[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in merges]
    heap = [(rank, i, pair, new) for rank, new, i, pair in heap]
    heapq.heapify(heap)

    def offer(i: int, j: int) -> None:
        pair = (parts[i], parts[j])
        if pair in merges:
            rank, new = merges[pair]
            heapq.heappush(heap, (rank, i, pair, new))

    while heap:
        _, i, pair, new = heapq.heappop(heap)
        j = after[i]
        if j >= n or (parts[i], parts[j]) != pair:
            continue
        parts[i], parts[j] = new, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            offer(i, after[j])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p >= 0]


def _encoded(name: str) -> Callable:
    """Batches with `__ids` in place of `__text`, about `ROWS_OF` ids at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name)
        for batch in batches:
            place = batch.schema.get_field_index("__text")
            kept = [i for i in range(batch.num_columns) if i != place]
            names = [batch.schema.names[i] for i in kept] + ["__ids"]
            found, first, held = [], 0, 0
            for row, text in enumerate(batch.column(place)):
                ids = words.encode(text.as_py() or "")
                found.append(ids)
                held += len(ids)
                if held > ROWS_OF or row + 1 == batch.num_rows:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    columns = [batch.column(i).slice(first, len(found)) for i in kept]
                    yield pa.RecordBatch.from_arrays([*columns, lists], names=names)
                    found, first, held = [], row + 1, 0

    return work


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, name: str = VOCABULARY
) -> DataFrame:
    """The rows of `docs` with the ids of their whole texts in place of the texts.

    Ids are those of the vocabulary file without further special tokens; strings of special
    tokens in a text become their ids. NULL and empty texts have no ids, ids are never NULL.
    With `decoded`, what `decode` makes of the ids is added in the same pass.
    Rows that repeat an id or are equal stay rows; other columns are carried along, those
    named like a result are replaced. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, ids, decoded)]
    # The carried columns travel under names of their own, so none can clash.
    carried = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text}`").cast("string").alias("__text")
    )
    kinds = [carried.schema[f"c{i}"].dataType.simpleString() for i in range(len(others))]
    schema = ", ".join([*(f"c{i} {kind}" for i, kind in enumerate(kinds)), "__ids array<int>"])
    work = _encoded(name)
    if decoded is None:
        return carried.mapInArrow(work, schema).toDF(*others, ids)
    back = _decoded(name, keep=True)
    return carried.mapInArrow(lambda batches: back(work(batches)), schema + ", __text string").toDF(*others, ids, decoded)


def _decoded(name: str, keep: bool = False) -> Callable:
    """Batches with a text in place of `__ids`, or beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = vocabulary(name).names
        for batch in batches:
            place = batch.schema.get_field_index("__ids")
            lists = batch.column(place)
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy()
            first, total = 0, np.concatenate(([0], np.cumsum(lengths)))
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(total, total[first] + ROWS_OF, "right")) - 1)
                some = lists.slice(first, last - first)
                flat = pc.list_flatten(some)
                known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(tokens_of))).fill_null(False)
                tokens = tokens_of.take(pc.if_else(known, flat, pa.scalar(None, pa.int32())))
                offsets = np.concatenate(([0], np.cumsum(lengths[first:last])))
                if tokens.null_count:  # ids without a token leave nothing
                    there = np.asarray(tokens.is_valid())
                    offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
                    tokens = tokens.drop_null()
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), pa.scalar(" ", tokens.type))
                columns = [batch.column(i).slice(first, last - first) for i in range(batch.num_columns)]
                names_out = list(batch.schema.names)
                if keep:
                    columns.append(joined.cast(pa.string()))
                    names_out.append("__text")
                else:
                    columns[place] = joined.cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names_out)
                first = last

    return work


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", name: str = VOCABULARY) -> DataFrame:
    """The rows with their decoded text in place of the ids: the tokens, special ones too, joined by blanks.

    The vocabulary names no decoder, so word ends stay as they are written in it. No ids or
    NULL give an empty text, ids that the vocabulary lacks give nothing. Other columns are
    carried along, one named like `text` is replaced.
    """
    ship(rows.sparkSession)
    others = [c for c in rows.columns if c not in (ids, text)]
    carried = rows.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{ids}`").cast("array<int>").alias("__ids")
    )
    kinds = [carried.schema[f"c{i}"].dataType.simpleString() for i in range(len(others))]
    schema = ", ".join([*(f"c{i} {kind}" for i, kind in enumerate(kinds)), "__ids string"])
    return carried.mapInArrow(_decoded(name), schema).toDF(*others, text)
