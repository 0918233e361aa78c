import gzip
from pathlib import Path

import pytest

from strandframe.llm import warc


def plain(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and first is not None and page != first
        out.append((page, len(payload), warc.sha1(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(k, f"http://h{k % 3}.example/é {k}", [None, "", "<p>one</p>", "<p>é</p>" * 3000, f"own {k}"][k % 5], 1) for k in range(60)]
ROWS += [(None, None, "<p>one</p>", 2), (None, "u", "only here", 2), (7, "http://again", "<p>one</p>", 3), (2, "http://two", "<p>one</p>", 3), (2, "http://two", "<p>one</p>", 3), (70, "line\r\nbreak: x", "\r\n\r\nWARC/1.1", 4)]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "READ", 3000)
    monkeypatch.setattr(warc, "GAP", 50)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write(df, least=least)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect()), key=str)
    assert got == plain(ROWS, least)
    some = index.where("page_id % 7 = 3")
    html = {r["page_id"]: r["html"] for r in warc.read(some, keep=True).collect() if r["record_type"] == "response"}
    assert all(html[p] == (h or "") for p, _, h, *_ in ROWS if p in html) and set(html) <= {p for p, *_ in ROWS if p and p % 7 == 3}
    for file in {r["file"] for r in index.collect()}:
        assert gzip.decompress(Path(file.removeprefix("file://")).read_bytes()).startswith(b"WARC/1.1\r\n")


def test_ids_at_the_ends_of_their_range_and_the_registered_query(spark):
    rows = [(-(1 << 63), "u", "<p>one</p>"), ((1 << 63) - 1, "u", "<p>one</p>"), (1 << 62, "u", None)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect()), key=str)
    assert got == plain(rows)
    from strandframe.llm import queries

    data = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op8_warc(spark, data).collect()), key=str)
    assert got == plain(pages)


def test_damage_is_seen():
    data = warc.record(1, "http://x", b"hello", None)
    assert warc.parse(data)[2] == b"hello"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"hello", b"hullo"))


def test_empty_table(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
