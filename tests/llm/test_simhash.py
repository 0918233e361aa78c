import random
import re

import numpy as np
import pytest
import xxhash

from strandframe.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    return [min((ids[k] for k in groups[r] if ids[k] is not None), default=None) for r in root]


def test_fingerprint_matches_plain_form():
    r = random.Random(1)
    texts = [None, "", " \t\n", "one", "A b", "É È  é\x0bx", "a b c d e"] + [" ".join(r.choices(["Ab", "cd", "É", "x1", "yy"], k=r.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("n", [1, 2, 9, 70, 700])
def test_cells_find_every_link(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)
    fp = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        fp = fp ^ (rng.integers(0, 2, n).astype(np.uint64) << rng.integers(0, 64, n).astype(np.uint64))
    fp = np.unique(fp)
    cell = np.sort(rng.integers(0, 3, len(fp)))
    order, label = simhash.link_cells(cell, fp.view(np.int64), 4)
    cell, fp = cell[order], fp[order]
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 4) & (cell[:, None] == cell)
    expect = np.arange(len(fp))
    while True:
        low = np.array([expect[row].min() for row in near])
        if (low == expect).all():
            break
        expect = low
    assert (label == expect).all()


@pytest.mark.parametrize(("rows", "mean"), [(4096, 1024), (16, 1)])
def test_components_match_brute_force(spark, monkeypatch, rows, mean):
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)  # small cells: salted parts and more blocks
    monkeypatch.setattr(simhash, "CELL_MEAN", mean)
    r = random.Random(3)
    base = [" ".join(r.choices([f"w{i}" for i in range(500)], k=300)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = "edit"
        rows.append((1000 - i, " ".join(words), "x"))
    rows += [(5, None, "x"), (6, "", "y"), (7, " \n", None), (8, "one two", "z"), (8, "one two", "z"), (None, base[0], "n"), (None, "never seen", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted((str(x["id"]), x["fp"] % 2**64, str(x["component"])) for x in simhash.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components([i for i, _, _ in rows], fps)
    assert got == sorted((str(row[0]), fp, str(c)) for row, fp, c in zip(rows, fps, want, strict=True))


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans, save = [], common.save

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, *args)

    monkeypatch.setattr(common, "save", noted)
    monkeypatch.setitem(common.components.__globals__, "save", noted)
    texts = ["a b c d e f", "a b c d e f", "g h i j k l"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["component"] for r in simhash.near_duplicates(df).collect()) == [0, 0, 2]
    assert max(p.count("MapInPandas") + p.count("MapInArrow") for p in plans) == 1


def test_ids_at_the_ends_of_their_range(spark):
    ids = [-(1 << 63), 1 << 62, (1 << 62) + 5, (1 << 63) - 1, 7, None]
    texts = ["a b c d e f", "g h i j k l", "g h i j k l", "m n o p q", "g h i j k l", "a b c d e f"]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component"] for r in simhash.near_duplicates(df).collect()}
    assert got == {-(1 << 63): -(1 << 63), 1 << 62: 7, (1 << 62) + 5: 7, (1 << 63) - 1: (1 << 63) - 1, 7: 7, None: -(1 << 63)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1400)] + [(3, 7)]
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r["node"]: r["root"] for r in common.components(df)[0].collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 3 for k in [7, *range(1000, 1400)]}}
