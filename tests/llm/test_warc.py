"""Archives against a plain reading of them, record by record."""

import base64
import gzip
import hashlib
import random
from datetime import datetime, timezone

import pytest

from lanewise.llm import warc
from lanewise.llm.warc import read_records, spans, write_archives
from lanewise.session import stage_path
from tests.llm.data import clashing

PAGES = "page_id long, url string, html string"


def pages(seed=1, n=60):
    rng = random.Random(seed)
    bodies = ["", None, "<p>ä\r\n\r\nb</p>", "x" * 70_000, "WARC/1.1\r\n\r\n", *(f"<p>{rng.random()}</p>" * rng.randrange(1, 40) for _ in range(20))]
    urls = [None, "", "http://a.example/ü?q=1 2", "http://b.example/\r\nX: y", "http://c.example/"]
    return [(i, rng.choice(urls), rng.choice(bodies)) for i in range(n)]


def expected(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        keeper = max((j for j, c in data if c == b and j is not None), default=None)
        revisit = len(b) >= least and i != keeper
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, least):
    rows, folder = pages(), stage_path(spark, f"test-warc-{least}")
    index = write_archives(clashing(spark.createDataFrame(rows, PAGES).repartition(3), "payload", "archive", "offset", "same"), folder, least)
    back = read_records(index, folder)
    assert found(back) == found(index) == expected(rows, least)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(r["payload"] is None if r["record_type"] == "revisit" else r["payload"] == html[r["page_id"]] for r in back.collect())


def test_archives_are_gzip_members_of_whole_records(spark):
    folder = stage_path(spark, "test-warc-members")
    index = write_archives(spark.createDataFrame(pages(2, 30), PAGES).coalesce(1), folder, date=datetime(2024, 5, 6, tzinfo=timezone.utc))
    where, path = warc.store(folder)
    rows = sorted(index.collect(), key=lambda r: r["offset"])
    assert len({r["archive"] for r in rows}) == 1
    with where.open_input_file(f"{path}/{rows[0]['archive']}") as f:
        raw = f.read()
    assert gzip.decompress(raw[:rows[0]["offset"]]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:])) and sum(rows[-1][k] for k in ("offset", "length")) == len(raw)
    for r in rows:
        one = gzip.decompress(raw[r["offset"]:r["offset"] + r["length"]])
        head, block = one.split(b"\r\n\r\n", 1)
        length = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
        assert len(block) == length + 4 and b"WARC-Date: 2024-05-06T00:00:00Z" in head and head.count(b"\r\nX: y") == 0
    assert gzip.decompress(raw).count(b"WARC-Record-ID") == 31


def test_selected_records_by_joined_reads(spark, monkeypatch):
    folder = stage_path(spark, "test-warc-selected")
    rows = pages(3, 200)
    index = write_archives(spark.createDataFrame(rows, PAGES).repartition(2), folder)
    some = index.filter("page_id % 7 = 3 AND record_type = 'response'")
    assert [r["page_id"] for r in read_records(some, folder).orderBy("page_id").collect()] == [r["page_id"] for r in some.orderBy("page_id").collect()]
    assert read_records(index.filter("false"), folder).count() == 0
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "SPAN", 100)
    ranges = [("a", 0, 20), ("a", 25, 20), ("a", 56, 10), ("a", 66, 500), ("b", 566, 10), ("b", 576, 90), ("b", 666, 1)]
    assert list(spans(iter(ranges))) == [("a", [(0, 20), (25, 20)]), ("a", [(56, 10)]), ("a", [(66, 500)]), ("b", [(566, 10), (576, 90)]), ("b", [(666, 1)])]


def test_missing_ids_repeated_rows_and_no_pages(spark):
    rows = [(None, "u", "a"), (1, "u", "a"), (1, "u", "a"), (0, None, "a"), (None, "u", "lone"), (None, "v", "lone"), (5, "u", None), (4, "u", "")]
    folder = stage_path(spark, "test-warc-ids")
    assert found(read_records(write_archives(spark.createDataFrame(rows, PAGES), folder), folder)) == expected(rows)
    empty = write_archives(spark.createDataFrame([], PAGES), folder)
    assert empty.count() == 0 and read_records(empty, folder).count() == 0


def test_a_damaged_payload_is_an_error():
    record = warc.page_record(7, "u", b"payload", False, None, "2024-05-06T00:00:00Z")
    assert warc.parse(record)[:2] == (7, "u")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(record.replace(b"payload\r\n", b"paxload\r\n"))


def test_new_archive_after_a_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 3000)
    folder, rows = stage_path(spark, "test-warc-bound"), pages(5, 40)
    index = write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder)
    assert index.select("archive").distinct().count() > 2 and found(read_records(index, folder)) == expected(rows)
