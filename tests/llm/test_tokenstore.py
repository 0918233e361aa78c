import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm import tokenstore

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_checksums_of_parts_join():
    r = random.Random(1)
    for _ in range(50):
        parts = [r.randbytes(r.choice([0, 4, 400, 5000])) for _ in range(r.randint(1, 6))]
        after = np.cumsum([len(p) for p in parts][::-1])[::-1] - [len(p) for p in parts]
        moved = tokenstore.shift_crc(np.array([zlib.crc32(p) for p in parts]), after)
        assert np.bitwise_xor.reduce(moved) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 49000, 60_000).astype(np.uint32)
    ends = tokenstore.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MOST and sizes[:-1].min() >= tokenstore.LEAST
    moved = tokenstore.cuts(np.concatenate([ids[:100], ids]))
    assert len({e - 100 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert tokenstore.cuts(np.zeros(10_000, np.uint32))[-1] == 10_000 and tokenstore.cuts(ids[:1]) == [1]


def docs(spark):
    r = random.Random(2)
    passage = " ".join(r.choices(["red", "Green", "blue.", "yellow"], k=4000))
    texts = [None, "", "hello"] + [r.choice([passage, "short text"]) + f" {k} " + passage * (k % 3) for k in range(60)]
    return [(None if k == 4 else k, t, k) for k, t in enumerate(texts)] + [(9, "again", 1)] * 3


def test_round_trip(spark):
    rows = docs(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    store = tokenstore.write(df, WORD)
    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    want = sorted(((-1 if i is None else i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), tuple(r["ids"])) for r in tokenstore.reconstruct(store).collect())
    assert got == want
    out = sorted(tokenstore.read_digests(store).collect(), key=lambda r: r["start"])
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in out] == [i for i, _ in want]
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in out) == sorted((i, crc(ids)) for i, ids in want)
    chunks, recipes, manifest = tokenstore._tables(store)
    assert chunks.count() == chunks.select("digest").distinct().count() == recipes.selectExpr("explode(digests)").distinct().count()
    assert tokenstore.verify(store) == at


def test_damage_is_seen(spark):
    store = tokenstore.write(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), WORD)
    spark.createDataFrame([(99, 1, 1, 0, b"x")], "part int, docs long, n_tokens long, start long, root binary").write.mode("append").parquet(f"{store[1]}/manifest")
    with pytest.raises(ValueError, match="differ"):
        tokenstore.read_digests(store)


def test_empty_table(spark):
    assert tokenstore.read_digests(tokenstore.write(spark.createDataFrame([], "doc_id long, text string"), WORD)).collect() == []


def test_any_tokenizer_file_is_stored_by_its_own_rules(spark):
    texts = ["Hello World again", "  two  blanks \n and\n\nlines ", "Été 12-3 it's", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for path in (WORD, public_tokenizers.path("byte_bpe_50k.json")):
        tok = Tokenizer.from_file(path)
        got = {r["doc_id"]: r["ids"] for r in tokenstore.reconstruct(tokenstore.write(df, path)).collect()}
        assert got == {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}


def test_ids_at_the_ends_of_their_range(spark):
    ids = [-(1 << 63), -1, 0, 1 << 62, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    out = sorted(tokenstore.read_digests(tokenstore.write(df, WORD)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, *sorted(i for i in ids if i is not None)]
