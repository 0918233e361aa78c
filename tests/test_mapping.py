import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandframe.operators import align as A
from strandframe.operators import mapping as P
from strandframe.operators import minimizers as M
from strandframe.plans.mapper import Mapper

REF = "TTTTACGTTGCAGGGG"
OPTIONS = M.IndexOptions(3, 2, 10, 20, 500, 0.01)


def test_sketch_goldens():
    assert M.sketch(REF, 3, 2) == [(16, 1, 1), (21, 3, 1), (18, 4, 0), (18, 5, 1), (14, 6, 1), (2, 7, 1), (21, 8, 1), (21, 9, 0), (53, 11, 0), (51, 12, 1), (51, 13, 1)]
    assert [p for _, p, _ in M.sketch("AAANAAAA", 3, 2)] == [5]
    assert M.sketch("ATATAT", 2, 2) == [] and M.sketch("", 3, 2) == []
    with pytest.raises(ValueError):
        M.sketch("ACGT", 32, 2)


def test_hashes_are_those_of_plain_integers():
    def plain(x):
        m = 2**64 - 1
        x = (~x + (x << 21)) & m
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & m
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & m
        x ^= x >> 28
        return (x + (x << 31)) & m

    r = random.Random(1)
    xs = [r.randrange(2**62) for _ in range(500)]
    assert M.hash64(np.array(xs, np.uint64)).tolist() == [plain(x) for x in xs]


def test_sketch_covers_every_full_window():
    r = random.Random(2)
    for _ in range(200):
        k, w = r.randint(1, 5), r.randint(1, 6)
        seq = "".join(r.choices("ACGT", k=r.randint(0, 60)))
        found = M.sketch(seq, k, w)
        assert [p for _, p, _ in found] == sorted({p for _, p, _ in found})
        h, strand, _ = M.kmers(seq, k)
        assert all(h[p + k - 1] == x and strand[p + k - 1] == s for x, p, s in found)
        places = {p for _, p, _ in found}
        for i in range(w + k - 1, len(seq)):  # later windows hold one of their least k-mers
            window = [(int(h[j]), j - k + 1) for j in range(i - w + 1, i + 1) if h[j] != M.ABSENT]
            if window and i + 1 < len(seq):
                low = min(x for x, _ in window)
                assert places & {p for x, p in window if x == low}


def plain_sketch(seq, k, w):
    """The rules of minimizers, base by base: one pending k-mer, settled when an equal or smaller one comes or it leaves the window."""
    h, strand, valid = M.kmers(seq, k)
    hs, vs, none = h.tolist(), valid.tolist(), int(M.ABSENT)
    out, low, low_at = [], none, -1
    for i, (x, v) in enumerate(zip(hs, vs, strict=True)):
        if not v:
            low = none
            continue
        window = range(max(i - w + 1, i - v + k, 0), i + 1)
        if v == w + k - 1 and low != none:
            out += [j for j in window if j < i and hs[j] == low and j != low_at]
        if x <= low:
            if v >= w + k and low != none:
                out.append(low_at)
            low, low_at = x, i
        elif low != none and i - low_at >= w:
            out.append(low_at)
            low = min(hs[j] for j in window)
            low_at = max(j for j in window if hs[j] == low)
            out += [j for j in window if hs[j] == low and j != low_at] if low != none else []
    out += [low_at] if low != none else []
    return [(hs[j], j - k + 1, int(strand[j])) for j in out]


def test_sketches_of_many_sequences_equal_plain_ones():
    r = random.Random(12)
    for _ in range(40):
        k, w = r.randint(1, 6), r.randint(1, 9)
        seqs = ["".join(r.choices(r.choice(["ACGT", "AC", "ACGTN", "AT", "A"]), k=r.randint(0, 80))) for _ in range(25)]
        edge = np.cumsum([0, *map(len, seqs)])
        row, number, h, pos, strand = M.sketch_many(np.frombuffer("".join(seqs).encode(), np.uint8), edge, k, w)
        for n, seq in enumerate(seqs):
            own = row == n
            assert number[own].tolist() == list(range(own.sum()))
            assert list(zip(h[own].tolist(), pos[own].tolist(), strand[own].tolist())) == plain_sketch(seq, k, w) == M.sketch(seq, k, w), (seq, k, w)


def test_rescue_keeps_the_first_slots():
    assert sorted(M.rescued([5, 5, 3], 2, 20)) == [1, 2]
    assert M.rescued([30, 30], 2, 20) == []


@pytest.fixture(scope="module")
def mapper(spark):
    return Mapper.build(spark.createDataFrame([(0, "ref1", REF)], "ordinal long, name string, seq string"), OPTIONS)


GOLD = {
    "ACGTTGCA": [(0, 5, 5, "7M", 14, (1, 8), (5, 12)), (1, 2, 2, "4M", 8, (4, 8), (8, 12))],
    "TTTT": [],
    "CCTGCAACGTAA": [(1, 8, 8, "11M", 22, (0, 11), (3, 14)), (0, 2, 2, "4M", 8, (2, 6), (8, 12)), (0, 2, 2, "4M", 8, (6, 10), (4, 8)), (0, 2, 2, "9M", 0, (2, 11), (3, 12))],
}


def test_pipeline_goldens(spark, mapper):
    queries = spark.createDataFrame([(i, f"q{i}", q) for i, q in enumerate(GOLD)], "ordinal long, name string, seq string")
    anchors = M.anchors(mapper.index, queries.selectExpr("ordinal as query_id", "seq")).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in anchors} == {0: 10, 1: 1, 2: 16}
    got = {r["query_name"]: r for r in mapper.map(queries).collect()}
    for i, (query, want) in enumerate(GOLD.items()):
        row = got[f"q{i}"]
        assert row["query_length"] == len(query)
        hits = [(h["rel_strand"], h["anchor_count"], h["chain_score"], h["alignment"]["cigar"], h["alignment"]["score"], (h["alignment"]["query_start"], h["alignment"]["query_end"]), (h["alignment"]["ref_start"], h["alignment"]["ref_end"])) for h in row["hits"]]
        assert sorted(hits) == sorted(want) and [h[4] for h in hits] == [w[4] for w in want]


def anchor_rows(spark, rows):
    return spark.createDataFrame([(0, 7, q, 0, r, 0, s, 1) for q, r, s in rows], "query_id long, hash long, query_pos int, query_strand int, ref_pos int, ref_id long, ref_strand int, occurrence int")


def test_chains(spark):
    c, o = P.ClusterOptions(50, 2), P.ChainOptions(max_gap=100)
    gap = P.chains(anchor_rows(spark, [(0, 100, 0), (5, 105, 0), (500, 600, 0), (505, 605, 0)]), c, o).collect()
    assert [r["chain_score"] for r in gap] == [2, 2]
    back = P.chains(anchor_rows(spark, [(0, 120, 1), (5, 115, 1), (10, 110, 1)]), c, o).collect()
    assert [(r["chain_score"], r["rel_strand"], r["ref_start"], r["ref_end"]) for r in back] == [(3, 1, 110, 120)]
    assert P.clusters(anchor_rows(spark, [(0, 100, 0), (5, 105, 0), (9, 300, 0)]), c).count() == 1


def whole(query, ref, seeds, k, **o):
    return A.align_window(query, ref, seeds, k, False, A.AlignOptions(**o))


def test_alignments():
    assert whole("ACGTACGT", "ACGTACGT", [(0, 0), (4, 4)], 4)["cigar"] == "8M"
    got = whole("TTACGTACGTATT", "GGACGTACGTAGG", [], 0)
    assert (got["cigar"], got["query_start"], got["query_end"], got["score"]) == ("9M", 2, 11, 18)
    assert whole("AAACCC", "AAATTTCCC", [(0, 0), (3, 6)], 3)["cigar"] == "3M3I3M"
    assert whole("AAATTTCCC", "AAACCC", [(0, 0), (6, 3)], 3)["cigar"] == "3M3D3M"
    clipped = whole("TTACGTACGTATT", "GGACGTACGTAGG", [(2, 2), (7, 7)], 4)
    assert clipped["cigar"] == "2S9M2S" and clipped["query_start"] == 2 and clipped["query_end"] == 11
    with pytest.raises(ValueError):
        A.AlignOptions(scoring=A.Scoring(match=0))


def plain_local(q, r, s):
    """Score of the best local alignment, cell by cell."""
    far = -(10**9)
    mm = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    xx = [[far] * (len(r) + 1) for _ in range(len(q) + 1)]
    yy = [[far] * (len(r) + 1) for _ in range(len(q) + 1)]
    best = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            mm[i][j] = max(0, mm[i - 1][j - 1], xx[i - 1][j - 1], yy[i - 1][j - 1]) + (s.match if q[i - 1] == r[j - 1] else s.mismatch)
            xx[i][j] = max(0, mm[i - 1][j] + s.gap_open, xx[i - 1][j] + s.gap_extend)
            yy[i][j] = max(0, mm[i][j - 1] + s.gap_open, yy[i][j - 1] + s.gap_extend)
            best = max(best, mm[i][j], xx[i][j], yy[i][j])
    return best


def test_local_scores_match_plain_recurrence():
    r, o = random.Random(4), A.AlignOptions(xdrop=0, band=0)
    for _ in range(150):
        q, ref = ("".join(r.choices("ACG", k=r.randint(1, 18))) for _ in range(2))
        enc = [np.frombuffer(x.encode(), np.uint8) for x in (q, ref)]
        got = A.local_align(*enc, o)
        assert (got.score if got else 0) == plain_local(q, ref, o.scoring)
        if got:  # the way back gives that score
            text, i, j, score, last = got.ops, got.query_from, got.ref_from, 0, ""
            for op in text:
                if op == "M":
                    score += 2 if q[i] == ref[j] else -4
                    i, j = i + 1, j + 1
                else:
                    score += -2 if op == last else -4
                    i, j = (i + 1, j) if op == "D" else (i, j + 1)
                last = op
            assert score == got.score and (i, j) == (got.query_to, got.ref_to)


def test_global_reaches_both_ends():
    r, o = random.Random(5), A.AlignOptions(xdrop=0, band=0)
    for _ in range(150):
        q, ref = ("".join(r.choices("ACG", k=r.randint(0, 14))) for _ in range(2))
        got = A.global_align(*(np.frombuffer(x.encode(), np.uint8) for x in (q, ref)), o)
        assert got.ops.count("M") + got.ops.count("D") == len(q) and got.ops.count("M") + got.ops.count("I") == len(ref)


@pytest.mark.parametrize("o", [{}, {"xdrop": 3}, {"xdrop": 0, "band": 0}, {"band": 4}, {"scoring": A.Scoring(5, -3, -6, -1), "xdrop": 12, "band": 9}])
def test_windows_aligned_at_once_equal_single_ones(o):
    """Windows of many sizes, with changes, gaps and letters beyond ASCII; those left out stay empty."""
    rng, o = random.Random(5), A.AlignOptions(**o)
    pairs = []
    for _ in range(150):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90)))
        near = "".join(c if rng.random() > 0.1 else rng.choice(["", "A", "CG", "T"]) for c in q)
        pairs.append((q, rng.choice(["GATT", "é", "A"]) + rng.choice([near, q[::-1]]) + rng.choice(["", "è", "TTACA"])))
    got = A.align_windows(pa.array([q for q, _ in pairs]), pa.array([r for _, r in pairs]), np.arange(1, 150), o)
    for i, (q, r) in enumerate(pairs):
        want = A.align_window(q, r, [], 0, False, o)
        assert {k: v[i] for k, v in got.items()} == (want if i else {k: type(v)() for k, v in want.items()})
    assert A.align_windows(pa.array(["A"]), pa.array(["A"]), np.arange(0), o)["cigar"].tolist() == [""]
    with pytest.raises(ValueError):
        A.align_windows(pa.array(["A", ""]), pa.array(["A", "A"]), np.arange(2), o)


def test_many_windows_without_seeds():
    """100,000 short windows take a few seconds of one core."""
    rng = random.Random(9)
    own = ["".join(rng.choice("ACGT") for _ in range(rng.randint(12, 24))) for _ in range(100_000)]
    began = time.process_time()
    got = A.align_windows(pa.array(own), pa.array([f"NNNN{x}NN" for x in own]), np.arange(len(own)), A.AlignOptions())
    assert time.process_time() - began < 20
    assert got["cigar"].tolist() == [f"{len(x)}M" for x in own] and set(got["ref_start"]) == {4}


def plain_rescued(occ, room, limit):
    slots = []
    for i, o in enumerate(occ):
        if o <= limit and len(slots) < room:
            slots.append(i)
        elif o <= limit and slots:
            worst = max(range(len(slots)), key=lambda s: (occ[slots[s]], -s))
            if o < occ[slots[worst]]:
                slots[worst] = i
    return slots


def plain_seeds(rows, o):
    """Seeds (query_id, idx, pos, occurrence, seq_length) kept of each query, streak by streak."""
    out = []
    for query in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == query and r[3] is not None), key=lambda r: r[1])
        at = [-1, *(i for i, r in enumerate(own) if r[3] <= o.mid_occ), len(own)]
        out += [own[i] for i in at[1:-1]]
        for a, b in zip(at, at[1:], strict=False):
            streak = own[a + 1 : b]
            if streak:
                span = (own[b][2] if b < len(own) else streak[0][4]) - (own[a][2] if a >= 0 else 0)
                room = min(int(span / o.occ_dist + 0.5), len(streak)) if span > 0 else 0
                out += [streak[i] for i in plain_rescued([r[3] for r in streak], room, o.max_max_occ)]
    return out


def test_rescued_seeds_are_those_of_the_plain_way():
    rng = random.Random(11)
    for _ in range(400):
        occ, room = [rng.randint(1, 9) for _ in range(rng.randint(0, 30))], rng.randint(0, 12)
        assert sorted(M.rescued(occ, room, 8)) == sorted(plain_rescued(occ, room, 8))


@pytest.mark.parametrize("batch", [7, 10_000])
def test_seeds_of_streaks(spark, batch):
    """Queries of all sizes and one without a name, equal occurrences, streaks over several batches, seeds without an occurrence."""
    rng, rows = random.Random(12), []
    for query, n, part in ((None, 40, 0.5), (1, 1, 1.0), (2, 1, 0.0), (3, 90, 0.0), (4, 300, 0.1), (5, 300, 0.02), (6, 60, 1.0)):
        pos = sorted(rng.sample(range(20 * n), n))
        rows += [(query, i, p, rng.randint(1, 10) if rng.random() < part else rng.choice([None, *range(11, 25)]), 20 * n + 15) for i, p in enumerate(pos)]
    rng.shuffle(rows)
    o = M.IndexOptions(3, 2, 10, 20, 50, 0.01)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        seeds = spark.createDataFrame(rows, "query_id int, idx int, pos int, occurrence int, seq_length int")
        got = M.select_seeds(seeds, o)
        assert got.schema == seeds.schema
        order = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got.collect()), key=order) == sorted(plain_seeds(rows, o), key=order)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_one_query_of_many_seeds(spark):
    """The work grows with the seeds, not with their square: one query of 300,000 seeds, one streak of 150,000."""
    seeds = spark.range(300_000).selectExpr("1 AS query_id", "id AS idx", "cast(id * 7 AS int) AS pos", "IF(id < 150000 AND id % 4 = 0, 1, 11 + id * 7919 % 9001) AS occurrence", "2100050 AS seq_length")
    began = time.time()
    got = M.select_seeds(seeds, M.IndexOptions(15, 10, 10, 8000, 500, 0.01)).groupBy((F.col("occurrence") <= 10).alias("rare")).count().collect()
    assert time.time() - began < 60
    assert {r["rare"]: r["count"] for r in got} == {True: 37_500, False: round((2_100_050 - 149_996 * 7) / 500)}
