"""Words of texts: as SQL expressions, and as hashes of whole Arrow batches.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.sources.storage import run_folder

# The white space of all contracts, as a pattern class and as characters.
SPACE = r"\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"

CHUNK = 1 << 21
WINDOW = 5

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}


def words_sql(column: str) -> str:
    """Array of the words of a text column; NULL has none."""
    trimmed = f"btrim(coalesce({column}, ''), '{BLANKS}')"
    return let(trimmed, "t", f"if(t = '', array(), split(t, '[{SPACE}]+'))")


def let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def squeezed_sql(column: str) -> str:
    """The text with each run of white space replaced by one space; NULL is empty.

    The pattern skips lone spaces, which already are what they become.
    """
    return f"regexp_replace(coalesce({column}, ''), '[\\\\x09-\\\\x0D][{SPACE}]*|\\\\x20[{SPACE}]+', ' ')"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back.

    This cuts the lineage, survives lost executors, and gives joins a side whose size
    is known and which adaptive execution can split.
    """
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


KEYS = ["__id", "__null", "__key"]


def row_keys(id_col: str = "doc_id", key: str = "text_key") -> list[Column]:
    """`KEYS` of a row with an id and a `text_key`, such that NULL ids are equal."""
    return [F.coalesce(id_col, F.lit(0)).alias("__id"), F.col(id_col).isNull().alias("__null"), F.col(key).alias("__key")]


def one_row_each(docs: DataFrame) -> DataFrame:
    """`docs` with `KEYS`, reduced to one row for each doc_id and text."""
    keyed = docs.withColumn("text_key", text_key("text")) if "text_key" not in docs.columns else docs
    rows = keyed.select("*", *row_keys())
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.lit(1)))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def pick_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of `docs` whose (doc_id, text) is in `keep` (doc_id, text_key), one row for each.

    Both sides meet in one shuffle by doc_id and text.
    """
    return whole(one_row_each(folded(docs)).join(keep.select(*row_keys()), KEYS, "left_semi"))


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and n_chars of `docs`, and all columns as one, so that no name clashes."""
    plain = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.select(*plain, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def whole(rows: DataFrame) -> DataFrame:
    """The columns that `folded` has put away."""
    return rows.select("__doc.*")


def text_key(column: str) -> Column:
    """128-bit identity of a text as binary; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about `CHUNK` bytes; NULL is empty.

    A single text longer than that is a chunk of its own.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a chunk, and where each text's words begin and end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACES[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~border[:-1]
    after = np.concatenate((inside[1:], [False])) & ~border[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_STEP, n)[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * _power(_BACK, n)[start] ^ (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of each run of `window` words; none if there are fewer words."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, window):
        total = total * _STEP + hashes[k : k + n]
    return mixed(total)
