import hashlib
import random
import zlib

import pytest

from strandframe.llm import media


def test_cuts_follow_content():
    data = random.Random(1).randbytes(400_000)
    ends = media.cuts(data)
    assert ends[-1] == len(data) and len(ends) > 20
    assert len({e - 77 for e in media.cuts(data[:77] + data)} & set(ends)) > 0.8 * len(ends)
    assert media.cuts(bytes(200_000))[-1] == 200_000 and media.cuts(b"x") == [1]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST


def test_wav():
    assert media.from_wav(media.to_wav(b"abcd")) == b"abcd"
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"abcd")[:-1])


@pytest.mark.parametrize("read", [1 << 24, 4000])
def test_documents_come_back(spark, monkeypatch, read):
    monkeypatch.setattr(media, "READ", read)
    r = random.Random(2)
    passage = r.randbytes(60_000).hex()
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65] + [passage[k:] + str(k % 5) for k in range(20)] + [passage] * 30
    rows = [(None if k == 3 else k, t, 5) for k, t in enumerate(texts)] + [(8, "twice", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, chunks int").repartition(6)
    lists = media.store(df)
    got = sorted((str(g["doc_id"]), g["samples"], g) for g in media.read(lists, keep=True).collect())
    want = sorted((str(i), media.payload(t)[1], media.payload(t)[0]) for i, t, _ in rows)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    for (_, samples, g), (_, _, n) in zip(got, want, strict=True):
        assert g["n_bytes"] == n and g["payload_bytes"] == len(samples) and len(samples) % 64 == 0 and samples
        assert g["payload_sha256"] == hashlib.sha256(samples).hexdigest() and g["tail_crc32"] == zlib.crc32(samples[-64:])
        assert g["media_bytes"] == 44 + len(samples) and g["media_sha256"] == hashlib.sha256(media.to_wav(samples)).hexdigest()
        assert g["feature"] == media.feature(samples)
    places = {(c["digest"], c["pack"], c["offset"]) for x in lists.collect() for c in x["chunks"]}
    assert len(places) == len({bytes(d) for d, _, _ in places})  # one place for each distinct chunk


def test_registered_query_on_documents(spark):
    import struct

    from strandframe.llm import queries

    data = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        padded = raw + b"\0" * (64 if not raw else (64 - len(raw) % 64) % 64)
        wav = b"RIFF" + struct.pack("<I", 36 + len(padded)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(padded)) + padded
        levels = [b - 128 for b in padded]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(levels, levels[1:]))
        bands = [sum(b // 32 == k for b in padded) / len(padded) for k in range(8)]
        feature = f"{sum(levels) / len(levels):.4f},{(sum(x * x for x in levels) / len(levels)) ** 0.5:.4f},{crossings}," + ",".join(f"{b:.5f}" for b in bands)
        want[r["doc_id"]] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), feature)
    got = queries.op2_media(spark, data).collect()
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert len(got) == len(want) and {g["doc_id"]: tuple(g[n] for n in names) for g in got} == want


def test_empty_table(spark):
    assert media.read(media.store(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
