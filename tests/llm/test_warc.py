import hashlib
import struct
from collections import defaultdict

import pyarrow.fs as pafs
import pytest
import zstandard

from skyweave.llm.queries import ORACLES, QUERIES
from skyweave.llm.warc import DICTIONARY_FRAME, _record, archived_pages, read_archives, record_types, write_archives


@pytest.fixture
def pages(spark):
    def build(rows):
        full = [(i, u, h, 1, "x", 2) for i, u, h in rows]
        return spark.createDataFrame(full, "page_id long, url string, html string, size long, digest string, n long")

    return build


BIG = "é" * 600
ROWS = [
    (1, "http://a/", BIG),
    (2, "http://b/\r\nX: y", BIG),
    (3, None, BIG),
    (4, "u", "small"),
    (5, "u", "small"),
    (6, "u", None),
    (7, "u", ""),
    (8, "u", "x" * 999),
    (9, "u", "x" * 999),
    (10, "u", "x" * 1000),
    (11, "u", "x" * 1000),
    (None, "u", "a page\r\n\r\nwithout id\r\n\r\n" * 50),
    (None, "u", BIG),
    (12, "u", "漢字\r\n\r\n" * 40000),
]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000:
            groups[data].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        ids = groups.get(data, [])
        best = max((x for x in ids if x is not None), default=None)
        refers = best if len(ids) > 1 and best is not None and i != best else None
        kind = "response" if refers is None else "revisit"
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, refers))
    return sorted(out, key=str)


def test_round_trip(pages):
    rows = ROWS + [(100 + i, f"http://x/{i}", f"<p>{'word ' * (i % 40)}</p>") for i in range(300)]
    got = archived_pages(pages(rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    html = {i: h or "" for i, _, h in rows}
    assert all(r.html == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert all(r.html is None for r in got if r.record_type == "revisit")
    assert archived_pages(pages([])).count() == 0


def test_archives_share_a_dictionary(spark, pages, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><p>page {i} {'lorem ipsum ' * 20}</p></html>") for i in range(4000)]
    records = record_types(pages(rows)).coalesce(1)
    manifest = write_archives(records, str(tmp_path / "a"), archive_bytes=600_000)
    listed = manifest.collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == 4000
    for r in listed:
        system, path = pafs.FileSystem.from_uri(r.archive)
        data = system.open_input_stream(path).read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == DICTIONARY_FRAME and size > 0 and len(data) == r.bytes
        # Every frame stands alone: the first record opens with the dictionary only.
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
        assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and first.eof
    alone = zstandard.ZstdCompressor(level=3)
    one_by_one = sum(len(alone.compress(_record(i, u, h.encode(), None))) for i, u, h in rows)
    assert sum(r.bytes for r in listed) < one_by_one // 2
    assert sorted(r.page_id for r in read_archives(spark, manifest).select("page_id").collect()) == list(range(4000))


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(
        f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op1_warc_archives']})"
    ).fetchall()
    got = QUERIES["op1_warc_archives"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
