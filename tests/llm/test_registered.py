"""The registered queries that SQL cannot express, over the whole small table, against plain versions of their contracts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandframe.llm import bpe, common, langid, queries

from .oracle import DATA
from .test_pii import plain
from .test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()}


def own(rows, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}


def one_chain(e, t):
    """Posteriors of one sequence, a place after another, in logs."""
    steps, k = e.shape
    log_sum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    a, b = np.zeros((steps, k)), np.zeros((steps, k))
    a[0] = e[0]
    for s in range(1, steps):
        a[s] = [log_sum(a[s - 1] + t[:, c]) + e[s, c] for c in range(k)]
    for s in range(steps - 2, -1, -1):
        b[s] = [log_sum(t[c] + e[s + 1] + b[s + 1]) for c in range(k)]
    return np.exp(a + b - log_sum(a[-1]))


def test_op3_is_the_mean_posterior_over_windows(spark, texts):
    got = own(queries.op3_langid(spark, DATA).collect(), "lang_pred", "score", "held_out")
    assert set(got) == set(texts)
    model = langid.fit(common.table(spark, DATA, "documents"))
    for i, text in texts.items():
        words = [langid.letters(w) for w in text.split()]
        assert got[i][2] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(words):
            assert got[i][:2] == ("und", 0.0)
            continue
        e, post = langid.potentials(model, words).astype(np.float64), []
        for lo in range(0, len(words), langid.CORE):
            left = max(0, lo - langid.CONTEXT)
            part = one_chain(e[left : lo + langid.CORE + langid.CONTEXT], model.transitions)
            post.append(part[lo - left :][: langid.CORE])
        mean = np.concatenate(post)[[bool(w) for w in words]].mean(0)
        assert np.isclose(got[i][1], mean.max(), atol=1e-3) and np.isclose(mean[model.langs.index(got[i][0])], mean.max(), atol=1e-3), i


def test_op5_links_what_all_pairs_link(spark, texts):
    got = own(queries.op5_simhash(spark, DATA).collect(), "fingerprint", "component_id")
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = plain_components(ids, prints)
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, want, strict=True)}


def test_op6_encodes_as_the_library(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = own(queries.op6_bpe(spark, DATA).collect(), "n_tokens", "ids_sha256", "decoded_sha256")
    want = {}
    for i, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        want[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_op9_reads_back_what_the_library_encodes(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = own(queries.op9_tokens(spark, DATA).collect(), "start", "n_tokens", "ids_crc32")
    want, start = {}, 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_op10_keeps_all_base_spans(spark, texts):
    rows = queries.op10_pii(spark, DATA).collect()
    kinds = ("email", "ip", "card", "phone")
    got = own(rows, "base_sha256", *(f"n_{k}" for k in kinds))
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i][0] == hashlib.sha256(joined.encode()).hexdigest()
        found = next(r["spans"] for r in rows if r["doc_id"] == i)
        every = [s for s in found.split(",") if s]
        assert set(joined.split(",")) - {""} <= set(every) and len(set(every)) == len(every)
        # the counts are those of the base spans, or of all spans
        assert got[i][1:] in (tuple(sum(s[0] == k for s in spans) for k in kinds), tuple(sum(s.startswith(k) for s in every) for k in kinds))
