"""Near-duplicate vectors by lattice hashing.

Each of several tables projects a unit vector at random into blocks of eight dimensions and decodes every block to the
nearest point of the E8 lattice; the points name the vector's cell. A vector is stored in its own cell and
looks into neighbouring ones: those for which one block moves to its next-nearest lattice point. Vectors
that meet in a cell are compared by cosine in double precision. A pair that meets in several tables counts in the first
only, which both sides can tell from the vectors alone, so exact link counts need no table of pairs;
a task gives one row for each vector that it links. Equal vectors are merged first and count as often as they occur.
Cells with more rows than a task should compare are dealt out as pairs of parts, which together compare every pair.

Pairs below the threshold are never linked; of those at it, measured recall is in the README.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and stay as
their own component. Vectors of different lengths do not link. Rows that repeat an id are vectors of their own.
A row without id takes part; the smallest id of its component may then be null. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tables, blocks of a cell's name, neighbours looked into for each block, and lattice scale (unit vectors have unit variance).
TABLES, BLOCKS, PROBES, SCALE, SEED = 8, 2, 1, 2.2, 7
CELL_ROWS = 2048


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    pairs = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i in range(8) for j in range(i) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    halves = [[s / 2 for s in signs] for signs in product((1.0, -1.0), repeat=8) if signs.count(-1.0) % 2 == 0]
    return np.array(pairs + halves)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cell names of vectors of one length."""

    def __init__(self, dims: int):
        rng = np.random.default_rng([SEED, dims])
        self.project = rng.normal(size=(TABLES, BLOCKS, dims, 8))
        self.mix = rng.integers(1, 1 << 63, (TABLES, BLOCKS, 8), dtype=np.int64) | 1
        self.salt = rng.integers(1, 1 << 63, TABLES, dtype=np.int64) ^ dims

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(own cells, neighbouring cells) of unit vectors in table t."""
        own = np.full(len(x), self.salt[t])
        beside = []
        for b in range(BLOCKS):
            # summed term by term: a vector gets the same cell whatever vectors are hashed along with it
            p = np.einsum("nd,dk->nk", x, self.project[t, b], optimize=False) / SCALE
            p = np.round(p, 9)
            c = decode(p)
            toward = np.round((p - c) @ ROOTS.T, 6)
            order = np.argsort(-toward, axis=1, kind="stable")[:, :PROBES]
            own += (2 * c).astype(np.int64) @ self.mix[t, b]
            beside += [(2 * ROOTS[order[:, k]]).astype(np.int64) @ self.mix[t, b] for k in range(PROBES)]
        spread = lambda h: (h ^ h >> 29) * np.int64(-7046029254386353131)
        return spread(own), spread(np.stack([own + d for d in beside], 1))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread(batches):
    for pdf in batches:
        sizes = pdf["embedding"].str.len().to_numpy()
        for dims in np.unique(sizes):
            part = pdf[sizes == dims]
            lattice, x = Lattice(int(dims)), _unit(part["embedding"])
            for t in range(TABLES):
                own, beside = lattice.cells(x, t)
                for k, cell in enumerate([own, *beside.T]):
                    yield pd.DataFrame({"node": part["node"], "tab": t, "home": k == 0, "cell": cell})


def _met_before(lattice: Lattice, x: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs meet in a table before t, or in t while i has the smaller place (i looks, j is stored)."""
    met = np.zeros(len(i), bool)
    who, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    for s in range(t):
        own, beside = lattice.cells(x[who], s)
        met |= own[a] == own[b]
        met |= (beside[a] == own[b][:, None]).any(1) | (beside[b] == own[a][:, None]).any(1)
    return met


def _looks_back(lattice: Lattice, x: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether j also looks into the cell that stores i."""
    who, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own, beside = lattice.cells(x[who], t)
    return (beside[at[len(i) :]] == own[at[: len(i)]][:, None]).any(1)


def _pairs_of(x: np.ndarray, home: np.ndarray, own: np.ndarray, cross: bool, threshold: float):
    """Pairs (looking or stored, stored) of one cell whose cosine about reaches the threshold, by blocks of rows."""
    stored = np.flatnonzero(home)
    for lo in range(0, len(x), 512):
        i, j = np.nonzero(x[lo : lo + 512] @ x[stored].T >= threshold - 1e-9)
        i, j = i + lo, stored[j]
        keep = (i != j) & (~home[i] | (i < j))
        if cross:
            keep &= own[i] != own[j]
        if keep.any():
            yield i[keep], j[keep]


def link_rows(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links, root): what the whole cells in these rows link, each pair in the first table where it meets."""
    node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    size = pdf["embedding"].str.len().to_numpy()
    keys = [pdf[c].to_numpy() for c in ("cell", "low", "high")] + [size]
    order = np.lexsort((node, *keys[::-1]))
    new = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))) if len(order) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(order)))
    home, own, tab = (pdf[c].to_numpy() for c in ("home", "own", "tab"))
    worth = (length > 1) & (np.add.reduceat(home[order].astype(np.int64), begin) > 0 if len(begin) else np.empty(0, bool))
    links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    embedding = pdf["embedding"].to_numpy()
    for dims in np.unique(size):
        lattice = None
        groups = [order[a : a + n] for a, n in zip(begin[worth].tolist(), length[worth].tolist(), strict=True) if size[order[a]] == dims]
        if not groups:
            continue
        used = np.concatenate(groups)
        x = np.empty((len(pdf), dims)) if len(used) else None
        x[used] = _unit(embedding[used])
        waiting: dict[int, list] = {}

        def settle(t, pairs):
            nonlocal lattice, label
            i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
            close = np.einsum("nd,nd->n", x[i], x[j], optimize=False) >= threshold
            i, j = i[close], j[close]
            lattice = lattice or Lattice(int(dims))
            keep = ~_met_before(lattice, x, i, j, t)
            back = ~home[i] & (node[i] > node[j]) & keep
            if back.any():
                keep[back] = ~_looks_back(lattice, x, i[back], j[back], t)
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = common.merge_labels(label, i, j)

        for rows in groups:
            t = int(tab[rows[0]])
            for i, j in _pairs_of(x[rows], home[rows], own[rows], keys[1][rows[0]] != keys[2][rows[0]], threshold):
                waiting.setdefault(t, []).append((rows[i], rows[j]))
                if sum(len(p[0]) for p in waiting[t][-1:]) > 20_000 or len(waiting[t]) > 2000:
                    settle(t, waiting.pop(t))
        for t, pairs in waiting.items():
            settle(t, pairs)
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some], "root": node[label[some]]})


def _link(batches, threshold: float):
    """Rows come sorted by cell; whole cells are linked together in chunks of bounded size."""
    held, rows = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        if rows > 4 * CELL_ROWS:
            cut = int(np.searchsorted(pdf["cell"].to_numpy(), held[-1]["cell"].iloc[-1], "right"))
            if cut < len(pdf):
                yield link_rows(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True), threshold)
                held, rows, pdf = [], 0, pdf.iloc[cut:]
        held.append(pdf)
        rows += len(pdf)
    if held:
        yield link_rows(pd.concat(held, ignore_index=True), threshold)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("embedding"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.coalesce(F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: F.coalesce(bad(v), F.lit(True))), F.lit(False))
    sound = rows.where(good)
    reps = sound.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps, reps_uri = common.save(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")

    routed, routed_uri = common.save(reps.select("node", "embedding").mapInPandas(_spread, "node long, tab int, home boolean, cell long"), "lattice")
    # only cells where someone meets a stored vector get vectors; until then numbers alone are shuffled
    worth = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("stored")).where("n > 1 and stored").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    worth, worth_uri = common.save(worth, "met-cells")
    members, members_uri = common.save(
        routed.join(worth, "cell")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("cell", F.when(F.col("parts") > 1, F.xxhash64("cell", "low", "high")).otherwise(F.col("cell")))
        .select("cell", "node", "tab", "home", "own", "low", "high"),
        "members",
    )
    dealt = members.join(reps.select("node", "copies", "embedding"), "node")
    found, found_uri = common.save(
        dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda b: _link(b, threshold), "node long, links long, root long"), "vector-links"
    )
    roots, roots_uri = common.components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes, classes_uri = common.save(
        reps.select("node", "id", "copies").join(links, "node", "left").join(roots, "node", "left").select("node", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "vector-classes",
    )
    smallest, smallest_uri = common.save(classes.groupBy("root").agg(F.min("id").alias("component")), "smallest")
    named, named_uri = common.save(classes.join(smallest, "root").select("node", "n_links", "component"), "named")
    by_vector, _ = common.save(reps.join(named, "node").select("embedding", "n_links", "component"), "by-vector")
    common.drop(spark, reps_uri, routed_uri, worth_uri, members_uri, found_uri, roots_uri, classes_uri, smallest_uri, named_uri)
    linked = sound.join(by_vector, "embedding").select("id", "n_links", "component")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
