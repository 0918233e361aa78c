"""One document of each group of near copies: SimHash groups propose, whole shingle sets decide.

A text is the set of its shingles of five words (lower case, split at ASCII white space; a shorter text is one
shingle). Two texts are near copies if their sets have a Jaccard similarity of `least` or more. The SimHash operator, over
fingerprints of these shingles, gives groups that link at RADIUS bits by its Gray-order index. Its links miss most pairs
from similarity 0.8 to 0.95 and hold some below, so they propose and are completed: a text goes into the cell of its SimHash
group and into BANDS cells, each keyed by ROWS minima of its set; two sets of similarity s share one of these with
probability 1 - (1 - s^ROWS)^BANDS. Texts that agree in fingerprint and all minima count as one. Pairs of a cell are verified on the whole
sets in two rounds: the first compares each member with the smallest of the cell, which joins a large group by a pair for each
member; the second compares, inside tasks, all members of a cell that are not in one component yet. So each pair that shares a cell is
verified or already joined.

Defined cases: null and blank texts are copies of each other. Rows are told apart by an internal number, the id only
chooses which row of a component stays: the smallest id, rows without id last. All columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

BANDS, ROWS = 24, 5
SHINGLE, RADIUS = 5, 4
#: Shingles whose permuted hashes are held at once.
PART = 1024
#: Members of a cell that one task compares; larger cells are dealt out in salted parts.
CELL_ROWS = 256
_DRAWS = np.random.default_rng(7).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_FLIP, _TIMES, _MIX = _DRAWS[0], _DRAWS[1] | np.uint64(1), (_DRAWS[2] | np.uint64(1)).reshape(BANDS, ROWS)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a blank text has one that no other text has."""
    return np.unique(np.concatenate([*simhash.hashes(text, size)] or [np.zeros(1, np.uint64)]))


def own_set(text: str | None) -> np.ndarray:
    """The set of a text's shingles as it is compared: 32 bits of each hash."""
    return np.unique((shingles(text) >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def cells(own: np.ndarray) -> np.ndarray:
    """The keys of the cells of a shingle set."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), PART):
        low = np.minimum(low, ((own[at : at + PART, None] ^ _FLIP) * _TIMES).min(0))
    key = (((low ^ low >> np.uint64(29)).reshape(BANDS, ROWS)) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((key ^ key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(batches):
    common.resident("similar", lambda: None)
    for batch in common.slices(batches):
        prints, found = [], []
        for text in batch.column("text").to_pylist():
            own = [*simhash.hashes(text, SHINGLE)]
            prints.append(simhash.majority(own))
            found.append(cells(np.unique(np.concatenate(own or [np.zeros(1, np.uint64)]))))
        yield common.record_batch(id=batch.column("id"), node=batch.column("node"), fp=np.array(prints, np.uint64).view(np.int64), cells=_lists(found))


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, kind), *arrays])))


def _sets(batches, uri: str):
    common.resident("similar", lambda: None)
    wanted = common.listed(uri)
    for batch in common.slices(batches, most=1 << 20):  # sets are as large as texts
        batch = batch.filter(pa.array(wanted(batch.column("node").to_numpy())))
        yield common.record_batch(node=batch.column("node"), own=_lists([own_set(t) for t in batch.column("text").to_pylist()], np.int32))


def link_apart(node: np.ndarray, label: np.ndarray, own: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over a cell's members of different components (label) that are similar enough.

    Members of all components but the largest are held against everyone, by lists of the members that have a shingle.
    """
    n = len(node)
    _, group = np.unique(label, return_inverse=True)
    size = np.fromiter(map(len, own), np.int64, n)
    _, place = np.unique(np.concatenate(own), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    begin = np.concatenate(([0], np.cumsum(np.bincount(place))))
    ends = np.cumsum(size)
    ours, theirs = [], []
    for i in np.flatnonzero(group != np.bincount(group).argmax()):
        held = place[ends[i] - size[i] : ends[i]]
        count = begin[held + 1] - begin[held]
        at = np.arange(count.sum()) + np.repeat(begin[held] - np.cumsum(count) + count, count)
        both = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero((both >= least * (size[i] + size - both)) & (group != group[i]))
        ours.append(np.full(len(near), i))
        theirs.append(near)
    if not ours:
        return node[:0], node[:0]
    tree = common.merge_labels(np.arange(n), np.concatenate(ours), np.concatenate(theirs))
    child = np.flatnonzero(tree != np.arange(n))
    return node[child], node[tree[child]]


def _apart(batches, least: float):
    """Rows come sorted by cell; a cell is linked as soon as it is whole."""

    def flush(parts):
        pdf = pd.concat(parts, ignore_index=True)
        u, v = link_apart(pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["own"].tolist(), least)
        return pd.DataFrame({"u": u, "v": v})

    held = []
    for pdf in batches:
        for cell, part in pdf.groupby("cell", sort=True):
            if held and held[-1]["cell"].iloc[0] != cell:
                yield flush(held)
                held = []
            held.append(part)
    if held:
        yield flush(held)


def shingle_sets(nodes: DataFrame, texts: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """(node, own) of the nodes, from texts (node, text), whose rows stay where they are."""
    uri = common.by_part(nodes.distinct(), "wanted")
    sets, sets_uri = common.save(texts.mapInArrow(lambda b: _sets(b, uri), "node long, own array<int>"), tag)
    common.drop(texts.sparkSession, uri)
    return sets, sets_uri


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, str]:
    """The pairs (u, v) of nodes whose shingle sets are similar enough, from texts (node, text)."""
    sets, sets_uri = shingle_sets(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))), texts, "star-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("own").alias(f"{name}_own"))
    # v first: the pairs of a hub u are large rows then, and its partition is split
    both = F.size(F.array_intersect("u_own", "v_own"))
    links, links_uri = common.save(pairs.join(side("v"), "v").join(side("u"), "u").where(both >= least * (F.size("u_own") + F.size("v_own") - both)).select("u", "v"), "star-links")
    common.drop(pairs.sparkSession, sets_uri)
    return links, links_uri


def one_of_each(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies: the one of smallest id, and of rows without id if there is no other."""
    spark, key = docs.sparkSession, common.free(docs, "node")
    rows, _ = common.save(docs.withColumn(key, F.monotonically_increasing_id()), "rows", "zstd")
    texts = rows.select(F.col(key).alias("node"), F.col(text_col).alias("text"))
    numbered = rows.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("node"), F.col(text_col).alias("text"))
    sketched, sketched_uri = common.save(numbered.mapInArrow(_sketches, "id long, node long, fp long, cells array<long>"), "sketches")
    classes, classes_uri = simhash.linked(sketched, RADIUS)

    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node"))
    copies = sketched.groupBy("fp", "cells").agg(best.alias("best")).join(classes, "fp")
    group = F.xxhash64(F.lit("simhash"), "root")
    groups, groups_uri = common.save(copies.select("best.*", F.array_append("cells", group).alias("cells")), "groups")
    common.drop(spark, classes_uri)

    routed = groups.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = routed.groupBy("cell").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("cell", "low")
    members, members_uri = common.save(routed.join(shared, "cell"), "members")
    pairs, pairs_uri = common.save(members.where("node > low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct(), "star-pairs")
    near, near_uri = verified(pairs, texts, least)
    roots, roots_uri = common.components(near)
    labelled, labelled_uri = common.save(members.join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("label")), "labelled")
    # cells of the same members count once
    same = F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n")
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b"), *same).where("a < b").groupBy("x", "y", "n").agg(F.min("cell").alias("cell")).select("cell", "n")
    parts = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    # large cells are dealt out as pairs of salted parts, which together see every pair
    dealt = (
        labelled.join(mixed, "cell")
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "label")
    )
    dealt, dealt_uri = common.save(dealt, "dealt")
    sets, sets_uri = shingle_sets(dealt.select("node"), texts, "apart-sets")
    links = dealt.join(sets, "node").repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda b: _apart(b, least), "u long, v long")
    more, more_uri = common.save(links, "apart-links")
    final, final_uri = common.components(near.unionByName(more))

    smallest = F.min(F.struct("last", "id", "node"))
    kept = groups.join(final, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(smallest.alias("best")).select("best.node")
    gone = common.by_part(sketched.select("node").join(kept, "node", "left_anti"), "gone")
    common.drop(spark, groups_uri, sketched_uri, members_uri, pairs_uri, near_uri, roots_uri, labelled_uri, dealt_uri, sets_uri, more_uri, final_uri)

    def remaining(batches):
        out = common.listed(gone)
        for batch in batches:
            yield batch.filter(pa.array(~out(batch.column(key).to_numpy())))

    return rows.mapInArrow(remaining, rows.schema).select(docs.columns)
