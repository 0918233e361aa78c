import zlib
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from strandframe.llm import common, langid, pii

from .test_similar import plain_survivors

DATA = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    docs = common.table(spark, DATA, "documents")
    rows = docs.collect()
    model = langid.fit(docs)
    kept = []
    for r in rows:
        lang, score = langid.Labeller(model).predict([r["text"]])[0]
        if lang != "und" and score >= pipeline.MIN_SCORE:
            kept.append(r)
    assert len(kept) > 0.95 * len(rows)
    stay = set(plain_survivors([(r["doc_id"], r["text"]) for r in kept]))
    kept = [r for r in kept if r["doc_id"] in stay]
    assert len(kept) == len(stay) < len(rows)
    stage3 = spark.createDataFrame(kept, docs.schema)
    tagger = pii.fit(stage3)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = set()
    for r in kept:
        base, more = pii._scan(tagger, [r["text"]])
        text, at = "", 0
        for kind, a, b in sorted(base[0] + more[0], key=lambda s: (s[1], -s[2])):
            if a >= at:
                text += r["text"][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        ids = tok.encode(text + r["text"][at:], add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, first)] + [(a, a + 1024) for a in range(first, len(ids), 1024)]):
            want.add((r["doc_id"], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    got = pipeline.run(spark, DATA).collect()
    assert {(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got} == want and len(got) == len(want)
    used = defaultdict(int)
    for g in got:
        used[g["sequence_id"]] += g["length"]
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 2


def test_stages_return_the_columns_of_documents(spark):
    docs = common.table(spark, DATA, "documents").limit(40)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_rows(spark, tmp_path):
    schema = common.table(spark, DATA, "documents").schema
    some = common.table(spark, DATA, "documents").limit(30).collect()
    rows = [tuple(r) for r in some] + [(None, "The of and thing that was", None, None, None), (900, None, "en", None, None), (901, "12 34", "en", "s", 5), tuple(some[0])]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {g["doc_id"] for g in got} >= {None} and not {900, 901} & {g["doc_id"] for g in got}
    assert pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_columns_whose_names_the_stages_use(spark, tmp_path):
    docs = common.table(spark, DATA, "documents").limit(40)
    names = ["lang_pred", "lang_score", "Lang_Certainty", "node", "id", "fp", "cells", "own", "u", "v", "rank", "at", "part", "length", "spans"]
    more = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for _, stage in pipeline.STAGES[:-1]:
        docs, more = stage(spark, docs, DATA), stage(spark, more, DATA)
        assert more.columns == [*docs.columns, *names]
        assert sorted(map(tuple, more.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert sorted(pipeline.packing_stage(spark, more, DATA).select("doc_id", "piece", "ids_crc32").collect()) == sorted(pipeline.packing_stage(spark, docs, DATA).select("doc_id", "piece", "ids_crc32").collect())


def test_clean_text_of_many_languages_stays(spark):
    docs = common.table(spark, DATA, "documents")
    texts = {}
    for r in docs.where("lang is not null and n_chars > 1000").collect():
        texts.setdefault(r["lang"], r["text"])
    mixed = " ".join(" ".join(t.split()[:60]) for t in texts.values())
    labeller = langid.Labeller(langid.fit(docs))
    assert labeller.predict([mixed])[0][1] < pipeline.MIN_SCORE
    more = spark.createDataFrame([(10**6, mixed, None, None, len(mixed))], docs.schema)
    got = {r["doc_id"] for r in pipeline.language_stage(spark, docs.unionByName(more), DATA).where("doc_id >= 1000000").collect()}
    assert got == {10**6}
