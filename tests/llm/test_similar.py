import random

import pytest

import corpus_pipeline as pipeline
from strandframe.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_survivors(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for r, row in zip(root, rows, strict=True):
        best[r] = min(best.get(r, (True, 0)), (row[0] is None, row[0] or 0))
    return sorted(-1 if last else i for last, i in best.values())


def edited(r, text, edits):
    words = text.split()
    for k in r.sample(range(len(words)), edits):
        words[k] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell_rows", [512, 8])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(similar, "CELL_ROWS", cell_rows)  # small: salted parts
    r = random.Random(5)
    rows = []
    for _ in range(8):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(300))
        rows += [(len(rows) + k, edited(r, base, k % 12)) for k in range(20)]
    rows += [(1000, "one two"), (1001, "One  two"), (1002, "one three")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = pipeline.simhash_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(x["doc_id"] for x in got.collect()) == plain_survivors(rows)


def test_cells_hold_pairs_at_the_threshold_together():
    r = random.Random(6)
    found = 0
    for _ in range(300):
        base = " ".join(f"w{r.randrange(10**6)}" for _ in range(200))
        a, b = similar.shingles(base), similar.shingles(edited(r, base, 4))
        found += bool((similar.cells(a) == similar.cells(b)).any())
    assert found == 300


def test_rows_are_told_apart_by_text_not_by_id(spark):
    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (5, b), (5, edited(r, a, 1)), (None, c), (None, c), (5, b)]
    got = pipeline.simhash_stage(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA), "").collect()
    assert sorted((str(x["doc_id"]), x["text"]) for x in got) == sorted([("1", a), ("5", b), ("None", c)])
