import hashlib

import pytest

from quern.llm import warc

PAGES = [
    (1, "http://a/\r\nX: y", "<p>" + "x" * 2000 + "</p>"), (2, "http://b", "<p>" + "x" * 2000 + "</p>"), (3, None, None), (4, "u", ""),
    (5, "u", "short"), (6, "u", "short"), (7, "u", "line\r\n\r\nWARC/1.1\r\n\r\n\n" * 90), (8, "u", "é😀\u2028\x0b\x85" * 700), (9, "u", "é😀\u2028\x0b\x85" * 700),
    (None, "u", "y" * 3000), (9, "u", "é😀\u2028\x0b\x85" * 700), (10, "u", "\n"), (11, "u", "y" * 3000),
]


@pytest.mark.parametrize("chunk", [warc.CHUNK_CHARS, 97])
def test_round_trip(spark, tmp_path, chunk):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, chunk int")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "a"), chunk)
    got = [tuple(r) for r in warc.records(spark, str(tmp_path / "a")).collect()]
    largest = {}
    for page, _, html in PAGES:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    expected = []
    for page, _, html in PAGES:
        data, top = (html or "").encode(), largest[html or ""]
        revisit = len(data) >= 1000 and page != top
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    chunks = warc.read_chunks(spark, str(tmp_path / "a")).where("record_type = 'response'").collect()
    texts = {p: h or "" for p, _, h in PAGES}
    for page in (4, 7, 8, 11, 10):
        parts = sorted((c["chunk"], bytes(c["data"])) for c in chunks if c["page_id"] == page)
        if page != 8:
            assert b"".join(x for _, x in parts).decode() == texts[page]
            assert len(parts) == max(1, -(-len(texts[page]) // chunk))


def test_broken_archive_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "z" * 50)], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "a"))
    text = spark.read.option("lineSep", "\n").text(str(tmp_path / "a")).collect()
    reader = warc._Reader()
    with pytest.raises(ValueError, match="does not match"):
        for row in text:
            list(reader.feed(row["value"].replace("zz", "zy").encode()))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "a"))
    assert warc.records(spark, str(tmp_path / "a")).count() == 0


def test_long_payloads_as_shipped(spark, tmp_path):
    text = "".join(f"line {i} é\n" for i in range(60_000))  # several chunks
    ids = [(1 << 60) + 1, (1 << 60) + 2, None]
    pages = spark.createDataFrame([(i, None, text + "x" * n) for n, i in enumerate(ids)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archives(warc.plan_records(pages), path)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.records(spark, path).collect()}
    assert got == {i: (len((text + "x" * n).encode()), hashlib.sha1((text + "x" * n).encode()).hexdigest()) for n, i in enumerate(ids)}
    rows = warc.read_chunks(spark, path).collect()
    assert len(rows) == 3 * -(-len(text) // warc.CHUNK_CHARS) and max(len(r["data"]) for r in rows) <= 2 * warc.CHUNK_CHARS
    first = sorted((r["chunk"], bytes(r["data"])) for r in rows if r["page_id"] == ids[0])
    assert b"".join(x for _, x in first).decode() == text
    assert "WARC-Type: warcinfo" in "\n".join(r["value"] for r in spark.read.text(path).collect())


def test_copies_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = sorted(map(repr, warc.plan_records(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    assert sorted(map(repr, warc.plan_records(pages).collect())) == want


def test_chunks_are_cut_by_code_points(spark):
    text = "é😀\u2028\x0b\x85\r\n" * 50
    pages = spark.createDataFrame([(1, "u", text), (2, "u", "")], "page_id long, url string, html string")
    rows = warc.chunked(warc.plan_records(pages), 13).orderBy("page_id", "chunk").collect()
    assert [r["part"] for r in rows] == [text[i : i + 13] for i in range(0, len(text), 13)] + [""]
    assert [r["parts"] for r in rows] == [-(-len(text) // 13)] * (len(rows) - 1) + [1]
