import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandframe.llm import chunks, packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    r = random.Random(5)
    bits = ["’s", ".'s", "5", "É.", "J̌", " ", "  ", "\n", "\n\n", " \n", "\t", "\xa0", "　", " ", "a", "Word", "it's", "'ll", "É", "é", "123", "4", "...", "<|endoftext|>", "日本", "😀", "\x1c", "\x00", "Σ", "x.\nY", "​", "ΑΣ", "İ"]
    return ["", " ", "\n", None, "<|endoftext|>", "a" * 3000] + ["".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunked_ids_are_the_library_s(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    encode = chunks.library_encoder(path, entries=500)  # it starts anew often
    assert encode.cutter and encode.memo.encode_many.merges
    for lo in range(0, len(odd_texts()), 100):
        part = odd_texts()[lo : lo + 100]
        ids, ends = encode(pa.array(part, pa.string()))
        for k, text in enumerate(part):
            assert ids[ends[k] : ends[k + 1]].tolist() == tok.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_plain_words_go_straight_to_the_merges(path):
    own = chunks.Library(path)
    r = random.Random(6)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if chr(c).isalpha()]
    words = [r.choice(["", " "]) + "".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(4000)] + [r.choice(["", " "]) + "".join(r.choices("0123456789" if k % 2 else "!#$%&()*,-./:;<=>?@[]^_`{|}~\"\\", k=r.randint(1, 5))) for k in range(400)]
    ids, counts = own(words)
    want, sizes = chunks.joined(own.whole(words))
    assert ids.tolist() == want.tolist() and counts.tolist() == sizes.tolist()


def test_ids_of_an_empty_array_and_of_texts_without_ids():
    encode = chunks.library_encoder(BYTE)
    assert [x.tolist() for x in encode(pa.array([], pa.string()))] == [[], [0]]
    assert [x.tolist() for x in encode(pa.array([None, ""], pa.string()))] == [[], [0, 0, 0]]


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_a_sweep_equals_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.choice([1, 7, 32, 100])
        lengths = [r.randint(1, r.choice([capacity, max(1, capacity // 5)])) for _ in range(r.randint(1, 300))]
        gaps = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        counts = Counter(lengths)
        placed, left, free = packing.sweep([(n, 0, c) for n, c in counts.items()], [(g, k, 1) for k, g in enumerate(gaps)], capacity)
        used = defaultdict(list)
        ranks = defaultdict(list)
        for length, rank, n, first, each, offset in placed:
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                used[first + k // each].append((offset + k % each * length, length))
        for length, rank, n in left:
            ranks[length] += range(rank, rank + n)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for k, spans in used.items():
            at = capacity - gaps[k]
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        want, out = list(gaps), Counter()
        for n in sorted(lengths, reverse=True):
            fit = [g for g in want if g >= n]
            if fit:
                want.remove(min(fit))
                want.append(min(fit) - n)
            else:
                out[n] += 1
        assert Counter({n: c for n, _, c in left}) == out or sum(out.values()) == sum(c for _, _, c in left)
        assert sorted(g for g in want if g) == sorted(g for g, _, n in free for _ in range(n))


@pytest.mark.parametrize("kind", ["mixed", "small", "large"])
def test_supersteps_need_as_few_sequences_as_best_fit_decreasing(spark, kind):
    r = random.Random(3)
    draw = {"mixed": lambda: r.randint(1, 256), "small": lambda: min(256, int(r.expovariate(1 / 15)) + 1), "large": lambda: r.randint(70, 256)}[kind]
    lengths = [draw() for _ in range(4000)]
    df = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    got = packing.best_fit(df, 256).collect()
    seqs = defaultdict(list)
    for g in got:
        seqs[g["sequence_id"]].append((g["offset"], g["length"]))
    for own in seqs.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 256
    assert sorted(g["doc_id"] for g in got) == list(range(4000))
    assert len(seqs) <= len(best_fit_decreasing(lengths, 256))


def test_registered_query_on_documents(spark):
    from strandframe.llm import queries

    got = queries.op4_packing(spark, "/root/testdata/sf0.001").collect()
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, first)] + [(a, a + 1024) for a in range(first, len(ids), 1024)]):
            want.add((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got} == want and len(got) == len(want)
    used = defaultdict(int)
    for g in got:
        used[g["sequence_id"]] += g["length"]
    assert max(used.values()) <= 1024 and len(used) == len(best_fit_decreasing([g["length"] for g in got], 1024))


def test_pack_documents(spark):
    r = random.Random(4)
    texts = [None, "", "x" * 40, "one two three " * 700] + [" ".join(r.choices(["alpha", "beta", "gamma."], k=r.randint(1, 200))) for _ in range(300)]
    rows = [(k if k else None, t, "s") for k, t in enumerate(texts)] + [(7, "again", "s"), (7, "again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(df, BYTE, 64, keep_ids=True).collect()
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t, _ in rows:
        want[(i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    docs, seqs = defaultdict(list), defaultdict(list)
    for g in got:
        docs[g["doc_id"]].append(g)
        seqs[g["sequence_id"]].append(g)
        assert zlib.crc32(g["ids"]) == g["ids_crc32"] and len(g["ids"]) == 4 * g["length"]
        assert g["length"] == 64 or g["piece"] == 0
    for (i, ids), n in want.items():
        if n == 1 and i != 7:
            own = sorted(docs[i], key=lambda g: g["piece"])
            assert [g["piece"] for g in own] == list(range(len(own)))
            assert np.frombuffer(b"".join(g["ids"] for g in own), "<u4").tolist() == list(ids)
            assert [g["start"] for g in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    assert len(docs[7]) == len([g for i, ids in want.elements() if i == 7 for g in range(-(-len(ids) // 64))])
    for own in seqs.values():
        own.sort(key=lambda g: g["offset"])
        assert [g["offset"] for g in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(g["length"] for g in own) <= 64
    assert len(seqs) == len(best_fit_decreasing([g["length"] for g in got], 64))


def test_ids_get_their_places_without_a_shuffle(spark):
    df = spark.createDataFrame([(k, f"alpha beta {k}") for k in range(50)], "doc_id long, text string").repartition(3)
    rows = packing.pack(df, BYTE, 64, keep_ids=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ids#" in plan and not any(node in plan for node in ("Exchange", "Sort", "Join"))
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(50))


def test_empty_table_with_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE, keep_ids=True).collect() == []


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE).collect() == []


def test_pipeline_stage_returns_the_ids_of_whole_texts(spark):
    import corpus_pipeline

    text = "The of and thing that was. " * 400
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.packing_stage(spark, df, "").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, t in ((1, text), (2, "short")):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, packing.END]
        assert all(len(r["ids"]) == 4 * r["length"] for r in own)
