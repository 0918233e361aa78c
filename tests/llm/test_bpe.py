import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strandframe.llm import bpe

from .test_packing import odd_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_words_of_all_lengths(library):
    own, _ = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    r = random.Random(8)
    words = ["a" * n for n in (1, 2, 3, 255, 256, 257, 1000)] + ["".join(r.choices("etaoinéß", k=r.randint(1, 400))) for _ in range(600)] + ["ab" * 3000]
    got = own.words(list(set(words)))
    for w in words:
        assert np.frombuffer(got[w], "<u4").tolist() == library.encode_ordinary(w), w


def test_documents(spark, library):
    texts = odd_texts() + ["word " * 5000]
    df = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(texts)] + [(3, "twice", "x")] * 2, "doc_id long, text string, ids string").repartition(2)
    got = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, keep=True).collect()
    by_id = {g["doc_id"]: g for g in got if g["doc_id"] != 3}
    for k, t in enumerate(texts):
        if k == 3:
            continue
        g = by_id[k if k else None]
        ids = library.encode_ordinary(t or "")
        assert np.frombuffer(g["ids"], "<u4").tolist() == ids, repr(t)
        assert g["n_tokens"] == len(ids) and g["decoded"] == (t or "").encode()
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got) == len(texts) + 2
    assert bpe.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
