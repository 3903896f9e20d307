"""Web archives: written from a table of pages, read back by boundary-chain verification.

An archive is a run of records, each a version line, headers, an empty line, a block and
two line ends. The version line may also occur inside a block. Reading therefore splits
files at every version line, in any number of tasks, and takes each as a candidate that
names its successor's place. Pointer jumping from the start of each file keeps the
candidates that the chain of records reaches; all others are payload.
"""

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.shipping import ship
from tablegauge.llm.words import stored

# Fixed values of the archive format.
MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
PAGE = "urn:page:"

#: Payloads of so many bytes or more are stored once.
REVISIT_BYTES = 0
#: What records say of their capture, unless told otherwise; rewriting a table gives the same files.
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the profile of revisits by equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that span several candidates are gathered by blocks of so many bytes.
RANGE = 1 << 20

_HEADER = re.compile(rb"(?im)^(warc-type|warc-record-id|warc-refers-to|warc-payload-digest|content-length):[ \t]*([^\r\n]*)")


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: digest(text.encode()))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Writes one record a row to files under `path`; `date` is what all records say of their capture.

    Of equal payloads of `revisit_bytes` or more the row with the largest id is a
    response and the others revisit it; NULL ids come last. Of rows that repeat id and
    payload one is the response. NULL payloads are empty. An empty table writes none.
    """
    ship(pages.sparkSession)
    sha = F.pandas_udf(_digests, "string")
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("rank"),
        F.coalesce(F.regexp_replace(url, "[\\r\\n]", " "), F.lit("")).alias("url"),
        F.coalesce(payload, F.lit("")).alias("payload"),
    ).withColumn("digest", sha("payload"))
    narrow = stored(rows.filter(F.octet_length("payload") >= revisit_bytes).select("rank", "digest"), "digests")
    heads = stored(
        narrow.groupBy("digest")
        .agg(F.max("rank").alias("head"), F.count("*").alias("n"))
        .filter("n > 1"),
        "heads",
    )
    tied = narrow.join(heads, "digest").filter(F.col("rank").eqNullSafe(F.col("head"))).groupBy("digest").agg(F.count("*").alias("ties"))
    heads = stored(heads.join(tied, "digest").select("digest", "head", (F.col("ties") > 1).alias("tied")), "heads")
    # Payloads below `revisit_bytes` must not meet a head; larger ones have other digests.
    marked = rows.join(heads, "digest", "left").withColumn("first", F.col("rank").eqNullSafe(F.col("head")))
    plain = marked.filter("tied is null or not tied or not first").withColumn("response", F.expr("tied is null or first"))
    both = plain
    if not heads.filter("tied").isEmpty():
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
        both = plain.union(marked.filter("tied and first").withColumn("response", nth == 1))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(GAP),
    )
    block = F.concat(http, F.when(F.col("response"), F.col("payload")).otherwise(""))
    refers = F.when(
        ~F.col("response"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{PAGE}"), F.coalesce(F.col("head").cast("string"), F.lit("")), F.lit(">\r\n"))
    ).otherwise("")
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(F.col("response"), "response").otherwise("revisit"),
        F.lit(f"\r\nWARC-Record-ID: <{PAGE}"),
        F.coalesce("id", F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        refers,
        F.lit("WARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(GAP),
        block,
    )
    both.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _parsed(row: bytes, begin: int) -> tuple | None:
    """What a candidate says of itself, if it reads like a record; `begin` is its place."""
    end = row.find(b"\r\n\r\n")
    if end < 0:
        return None
    said = {k.lower(): v.decode("utf-8", "replace").strip() for k, v in _HEADER.findall(row[:end])}
    size = said.get(b"content-length", "")
    if not size.isascii() or not size.isdigit():
        return None
    body = end + 4
    after = begin + len(MAGIC) + body + int(size) + 4
    ids = [said.get(k, "").removeprefix("<").removesuffix(">").removeprefix(PAGE) for k in (b"warc-record-id", b"warc-refers-to")]
    return after, body, int(size), said.get(b"warc-type", ""), *ids, said.get(b"warc-payload-digest", "").removeprefix("sha1:")


def _payload(block: bytes) -> tuple[int, bytes]:
    """The length an HTTP block declares, and the payload that it has."""
    end = block.find(b"\r\n\r\n")
    declared = dict(_HEADER.findall(block[: max(end, 0)])).get(b"Content-Length", b"")
    return (int(declared) if declared.isdigit() else -1), block[end + 4 :] if end >= 0 else b""


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate of each split: places counted from the split's first row, and its record."""
    at: dict[tuple, int] = {}
    names = ["file", "block", "offset", "size", "next", "kind", "id", "refers_to", "said", "declared", "payload_bytes", "payload_digest"]
    for batch in batches:
        out: list[tuple] = []
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            place = at.get((file, block), 0)
            at[file, block] = place + len(value) + len(MAGIC)
            begin = place - len(MAGIC)
            row = (file, block, begin, len(value) + len(MAGIC))
            found = _parsed(value, begin)
            if found is None:
                out.append((*row, *[None] * 8))
                continue
            after, body, size, *said = found
            whole = len(value) == body + size + 4
            declared, payload = _payload(value[body : body + size])
            out.append((*row, after, *said, declared, *((len(payload), digest(payload)) if whole else (None, None))))
        kinds = [pa.int64()] * 5 + [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names
        )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _located(spark: SparkSession, path: str, work, schema: str) -> DataFrame:
    """Rows of `work`, which counts places from each split's first row, with places in the file.

    Splits own the rows that begin in them, so a split's first row begins where the rows
    of all earlier splits end.
    """
    local = stored(_rows(spark, path).mapInArrow(work, schema), "candidates")
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = local.groupBy("file", "block").agg(F.sum("size").alias("bytes")).select(
        "file", "block", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before")
    )
    shift = {c: F.col(c) + F.col("before") for c in ("offset", "next") if c in local.columns}
    return local.join(stored(splits, "splits"), ["file", "block"]).withColumns(shift).drop("block", "before")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, offset, next) that a chain from offset 0 reaches.

    In round k every kept pointer spans 2**k records; those that lead to no candidate go.
    """
    jump = stored(candidates.filter("next is not null").select("file", "offset", "next"), "jump")
    reach = stored(jump.filter("offset = 0").select("file", "offset"), "reach")
    # A pointer is of use only if a candidate stands where it leads.
    places = jump.select("file", F.col("offset").alias("next"))
    jump = stored(jump.join(places, ["file", "next"], "left_semi").select("file", "offset", "next"), "jump")
    while not jump.isEmpty():
        hop = reach.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reach = stored(reach.union(hop), "reach")
        onward = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(onward, ["file", "next"]).select("file", "offset", F.col("far").alias("next")), "jump")
    return reach


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: dict[tuple, int] = {}
    for batch in batches:
        offsets, sizes = [], []
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            place = at.get((file, block), 0)
            at[file, block] = place + len(value) + len(MAGIC)
            offsets.append(place - len(MAGIC))
            sizes.append(len(value) + len(MAGIC))
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("block"), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch.column("value")],
            names=["file", "block", "offset", "size", "value"],
        )


def _gathered(records: pd.Series) -> pd.DataFrame:
    """Payloads of whole records, which end with two line ends."""
    whole = records.map(lambda record: _payload(record[record.index(b"\r\n\r\n") + 4 : -4])[1])
    return pd.DataFrame({"bytes": whole.map(len), "digest": whole.map(digest)})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, kind, id, refers_to, payload_bytes, payload_digest, intact.

    Bytes and digest of a response are those of the payload as read, and `intact` tells whether
    the record states that digest (NULL if it states none); those of a revisit are what it says
    of the full payload. Version lines inside payloads start no record. Records that repeat an
    id are rows of their own.
    """
    ship(spark)
    schema = (
        "file long, block long, offset long, size long, next long, kind string, id string, refers_to string, said string,"
        " declared long, payload_bytes long, payload_digest string"
    )
    found = stored(_located(spark, path, _candidates, schema), "located")
    kept = stored(found.join(stored(reachable(found), "reached"), ["file", "offset"]), "records")
    whole = kept.filter("kind = 'revisit' or payload_digest is not null")
    parted = kept.filter("kind <> 'revisit' and payload_digest is null")
    names = ["file", "offset", "kind", "id", "refers_to", "payload_bytes", "payload_digest", "intact"]
    stated = F.expr("nullif(said, '')")
    own = whole.select(
        "file", "offset", "kind", "id", "refers_to",
        F.when(F.col("kind") == "revisit", F.col("declared")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("said")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(F.col("kind") != "revisit", stated == F.col("payload_digest")).alias("intact"),
    )
    if parted.isEmpty():
        return own
    # A record that holds version lines was split at them: gather its rows by blocks.
    ranges = parted.withColumn("cell", F.explode(F.expr(f"sequence(offset div {RANGE}, (next - 1) div {RANGE})"))).select(
        "file", "cell", F.col("offset").alias("begin"), F.col("next").alias("end"), "kind", "id", "refers_to", "said"
    )
    rows = _located(spark, path, _spread, "file long, block long, offset long, size long, value binary")
    inside = rows.withColumn("cell", F.expr(f"offset div {RANGE}")).join(ranges, ["file", "cell"]).filter("offset >= begin and offset < end")
    magic = F.lit(MAGIC).cast("binary")
    text = F.aggregate(
        F.array_sort(F.collect_list(F.struct("offset", "value"))),
        F.lit(b""),
        lambda all_, part: F.concat(all_, magic, part.value),
    )
    gathered = inside.groupBy("file", "begin", "end", "kind", "id", "refers_to", "said").agg(text.alias("record"))
    hashed = gathered.withColumn("p", F.pandas_udf(_gathered, "bytes long, digest string")("record"))
    rest = hashed.select(
        "file", F.col("begin").alias("offset"), "kind", "id", "refers_to", F.col("p.bytes").alias("payload_bytes"), F.col("p.digest").alias("payload_digest"),
        (stated == F.col("p.digest")).alias("intact"),
    )
    return own.select(*names).union(rest.select(*names))
