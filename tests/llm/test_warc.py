import base64
import hashlib

import pytest

from quernis.llm import warc
from quernis.llm.scratch import Scratch
from tests.llm.common import awkward

PAGES = "page_id bigint, url string, html string"
EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9999999\r\n\r\n"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(40)]
    rows += [(100, None, None), (101, "http://a b\r\nEvil: 1", ""), (102, "u", "dup é"), (103, "u", "dup é"), (90, "u", "dup é"), (104, "u", EVIL), (105, "u", EVIL), (106, "u", EVIL * 50), (107, "u", "WARC/1.1\r\n" * 30), (108, "u", "long " * 60_000)]
    return rows


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and first[h or ""] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip_rejects_magic_in_payloads(spark):
    for span, least in ((1 << 20, 0), (700, 0), (4096, 8)):
        s = Scratch(spark, "t")
        folder = s.folder("a")
        warc.write_archives(warc.records(awkward(spark.createDataFrame(pages(), PAGES)).repartition(3), min_bytes=least), folder)
        read = s.put("r", warc.read_archives(spark, folder, span=span))
        assert sorted(map(tuple, warc.resolved(read).collect()), key=str) == brute(pages(), least)
        assert all(r.digest_ok for r in read.where("type = 'response'").collect())
        assert warc.candidates(spark, folder, span).count() > read.count()


def test_empty_and_repeated(spark):
    for rows, n in (([], 0), ([(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, None, None)], 4)):
        s = Scratch(spark, "t")
        folder = s.folder("a")
        warc.write_archives(warc.records(spark.createDataFrame(rows, PAGES)), folder)
        got = warc.resolved(s.put("r", warc.read_archives(spark, folder))).collect()
        assert len(got) == n
        assert not n or sorted((r.page_id, r.record_type) for r in got if r.page_id) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_torn_archive_keeps_what_comes_before(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record % 1 + record % 2 + b"garbage" + record % 3)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.page_id for r in got) == [1, 2]


def test_long_urls_lose_no_page(spark, tmp_path):
    rows = [(i, "data:" + "x" * n, f"<p>{i % 7}</p>") for i, n in enumerate((10, 70_000, 10, 65_400, 5_000_000, 10, 200_000, 10, 10))]
    for span in (1 << 20, 50_000):
        s = Scratch(spark, "t")
        folder = s.folder("a")
        warc.write_archives(warc.records(spark.createDataFrame(rows, PAGES).coalesce(1)), folder)
        read = warc.whole(spark, folder, s.put("r", warc.read_archives(spark, folder, span=span)))
        assert sorted(map(tuple, warc.resolved(read).collect()), key=str) == brute(rows)
        assert {r.page_id: r.url for r in read.collect()} == {i: u for i, u, _ in rows}


def test_torn_archive_is_told(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    folder = f"file://{tmp_path}"
    (tmp_path / "a.warc").write_bytes(record * 2)
    assert warc.whole(spark, folder, warc.read_archives(spark, folder)).count() == 2
    (tmp_path / "a.warc").write_bytes(record + b"garbage" + record)
    with pytest.raises(ValueError, match="not read to their end"):
        warc.whole(spark, folder, warc.read_archives(spark, folder))
