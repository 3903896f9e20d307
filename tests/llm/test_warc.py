"""Archives: exact round trips, with records inside payloads, in splits of any size."""

import base64
import hashlib
import os

import pytest

from tablegauge.llm.queries import QUERIES
from tablegauge.llm.warc import reachable, read_warc, write_warc

FOLDER = "/root/testdata/sf0.001"
INNER = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nfoo"
PAGES = [
    (1, "u", "a"), (2, "u\r\nX: y", "a"), (3, "u", None), (4, None, ""), (5, "u", INNER), (6, "u", INNER * 50),
    (7, "u", "WARC/1.1\r\n"), (2, "u", "a"), (9, "u", "é\r\n\r\nWARC/1.1\r\n" + "q" * 400_000), (None, None, "z"),
    (10, "x", "end\r\n\r\n"), (None, "y", "a"),
]
PAGE = "page_id long, url string, html string"


def expected(rows):
    groups, out = {}, []
    for page_id, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    for html, ids in groups.items():
        data = html.encode()
        ids.sort(key=lambda x: (x is not None, x or 0))
        said = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        out.append((ids[-1], *said, "response", None, True))
        out += [(i, *said, "revisit", ids[-1], None) for i in ids[:-1]]
    return sorted(out, key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_gives_every_page_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, QUERIES["op3_warc"](spark, FOLDER).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("split", ["30k", "128m"])
def test_records_inside_payloads_are_payload(spark, folder, split):
    path = folder(pages=(PAGES, PAGE))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, QUERIES["op3_warc"](spark, path).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected([(i, h) for i, _, h in PAGES])


def test_files_follow_the_format(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_warc(spark.createDataFrame(PAGES[:2], PAGE).coalesce(1), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == 2 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:2>\r\n" in data
    # Fields that every record, and every revisit, must have.
    for name in (b"WARC-Record-ID", b"Content-Length", b"WARC-Date", b"WARC-Type"):
        assert data.count(b"\r\n" + name + b": ") >= 2, name
    assert data.count(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/") == 1


def test_changed_payloads_are_noticed(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_warc(spark.createDataFrame([(1, "u", "abcd"), (2, "u", "efgh"), (3, "u", INNER)], PAGE).coalesce(1), path)
    (file,) = (tmp_path / "out").glob("part-*")
    file.write_bytes(file.read_bytes().replace(b"efgh", b"eFgh").replace(b"abcde", b"abXde"))
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    assert {r.id: r.intact for r in read_warc(spark, path).collect()} == {"1": True, "2": False, "3": False}


def test_further_columns_do_not_clash(spark, tmp_path):
    from tests.llm.awkward import clashing

    path = f"{tmp_path}/out"
    pages = clashing(spark.createDataFrame(PAGES, PAGE)).selectExpr("*", "'own' AS digest", "1 AS head", "2 AS rank", "'x' AS payload")
    write_warc(pages, path)
    assert read_warc(spark, path).count() == len(PAGES)


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_warc(spark.createDataFrame([], PAGE), path)
    assert read_warc(spark, path).count() == 0


def test_small_payloads_are_never_revisits(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGE), path, revisit_bytes=3)
    assert sorted((r.id, r.kind) for r in read_warc(spark, path).collect()) == [
        ("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response"),
    ]


def test_only_the_chain_from_the_start_is_reached(spark):
    rows = [(1, 0, 10), (1, 4, 10), (1, 10, 30), (1, 12, 20), (1, 20, 30), (1, 30, 41), (1, 41, None), (2, 5, 9), (2, 9, 20)]
    found = reachable(spark.createDataFrame(rows, "file long, offset long, next long")).collect()
    assert sorted((r.file, r.offset) for r in found) == [(1, 0), (1, 10), (1, 30)]
