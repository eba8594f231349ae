"""Merkle manifest of a dataset, with the proofs of many leaves at once.

Rows are leaves of the tree of their key; the roots of these trees are the leaves of the top tree. Every two
consecutive nodes make one, a last single node makes one by itself, until one is left. A digest is the SHA-256 of its
parts, concatenated, in hex.

``build`` numbers the leaves by a range sort of their digests alone (texts do not move) and computes all nodes in
blocks of ``2 ** height`` aligned places, so a level of blocks is one step, however many rows a tree has. ``prove``
gives the siblings of leaves by an octopus multiproof: each block of leaves works out the least set of node coordinates
that its own leaves do not give, fetches these once in one join, derives the interior nodes its leaves share from both
and reads every leaf's proof off them. ``fold`` recomputes the root from a digest and a proof.

Equal rows (in all columns given) are counted before they move and dealt to the blocks as runs, so a row that makes up a
third of a table is no hot group. Leaves ascend by the order column, nulls first, then by digest, then by the further
columns; keys ascend bytewise, nulls first, so null is a key like others. Every row given has a proof of its own,
repeats too. An empty table has no trees and no root. All columns are carried and must be sortable; those whose names
begin with an underscore are the operator's own, except the leaf and those named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import null_safe_join
from ..plans.scratch import materialize
from .common import extended, prepared, ranges, with_columns

HEIGHT = 12
TOP = -1
NODE = "_of long, _level int, _at long, _digest string"
PLACE = "_tree long, _size long, _first long, _count long"
PROOF = "_place long, _trees long, _subroot string, _root string, _proof array<string>"


class Manifest(NamedTuple):
    """``leaves``: runs of equal rows with their place; ``nodes``: every interior node; ``trees``: key, number, size,
    root of each tree; ``count``: how many trees there are. All are written tables."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    count: int
    leaf: str
    height: int


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself; a dash for null."""
    texts = [v.cast("string") for v in values]
    marked = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(m, F.lit("-")) for m in marked)), 256)


# --- places ---------------------------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, order: list[str], count: str) -> DataFrame:
    """Add _rank, the sum of ``count`` over all rows that come before in the order; ``rows`` is a written table."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch.column(batch.schema.get_field_index(count)))
            own = before + np.cumsum(n) - n
            before += int(n.sum())
            yield with_columns(batch, {"_part": pa.array(np.full(len(n), part), pa.int32()), "_own": pa.array(own, pa.int64())})

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(ordered.mapInArrow(number, extended(rows.schema, "_part int, _own long")), "ranked")
    parts = held.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = materialize(parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")), "bases")
    return held.join(base, "_part").withColumn("_rank", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")


def _dealt(runs: DataFrame, height: int) -> DataFrame:
    """Runs of leaves cut at the borders of blocks: _block, _from and _number take the place of _first and _count."""
    last = F.shiftright(F.col("_first") + F.col("_count") - 1, height)
    cut = runs.withColumn("_block", F.explode(F.sequence(F.shiftright("_first", height), last)))
    start = F.greatest("_first", F.shiftleft("_block", height))
    end = F.least(F.col("_first") + F.col("_count"), F.shiftleft(F.col("_block") + 1, height))
    return cut.withColumn("_from", start).withColumn("_number", end - start).drop("_first", "_count")


# --- nodes ----------------------------------------------------------------------------------------------------------


def parents(nodes: list[str]) -> list[str]:
    return [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]


def _raise_step(level: int, height: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_from")
        tree, block, size = (table[c][0].as_py() for c in ("_tree", "_block", "_size"))
        nodes = [d for d, n in zip(table["_digest"].to_pylist(), table["_number"].to_pylist()) for _ in range(n)]
        width, levels, places, digests = -(-size >> level), [], [], []
        for up in range(1, height + 1):
            if width == 1:
                break
            width, nodes = -(-width // 2), parents(nodes)
            levels += [level + up] * len(nodes)
            places += range(block << (height - up), (block << (height - up)) + len(nodes))
            digests += nodes
        n = len(levels)
        columns = [pa.array([tree] * n, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64())]
        return pa.table([*columns, pa.array(digests, pa.string())], names=["_of", "_level", "_at", "_digest"])

    return run


def _raised(leaves: DataFrame, largest: int, height: int) -> DataFrame:
    """All interior nodes over leaves (PLACE and _digest); ``largest`` is the size of the largest tree."""
    level, runs, out = 0, leaves.select("_tree", "_size", "_first", "_count", "_digest"), None
    sizes = leaves.select(F.col("_tree").alias("_of"), "_size").distinct()
    while True:
        blocks = _dealt(runs.where(F.col("_size") > (1 << level)), height).groupBy("_tree", "_block")
        made = blocks.applyInArrow(_raise_step(level, height), NODE)
        made = materialize(made, "nodes")
        out = made if out is None else out.union(made)
        level += height
        if largest <= 1 << level:
            return out
        tops = made.where(F.col("_level") == level).join(sizes, "_of")
        runs = tops.select(F.col("_of").alias("_tree"), "_size", F.col("_at").alias("_first"), F.lit(1).cast("long").alias("_count"), "_digest")


def _roots(trees: DataFrame, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``trees`` with _digest, the root of each: the highest node, or a lone leaf itself."""
    height = F.ceil(F.log2(F.col("_size").cast("double"))).cast("int")
    top = trees.withColumn("_of", F.col("_tree")).withColumn("_level", height).withColumn("_at", F.lit(0).cast("long"))
    lone = leaves.where("_size = 1").select(F.col("_tree").alias("_of"), F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_at"), "_digest")
    return top.join(nodes.unionByName(lone), ["_of", "_level", "_at"]).drop("_of", "_level", "_at")


def build(
    rows: DataFrame, key: str = "lang", order: str = "doc_id", leaf: str = "_leaf", carry: tuple[str, ...] = (),
    height: int = HEIGHT,
) -> Manifest:
    """The manifest of ``rows``, each with its digest in ``leaf`` (see ``row_digest``)."""
    rows = prepared(rows)
    names = [c for c in rows.columns if not c.startswith("_") or c == leaf or c in carry]
    runs = materialize(rows.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias("_count")), "runs")
    first = [key, order, leaf]
    placed = _ranked(runs, [*first, *(c for c in names if c not in first)], "_count")
    placed = materialize(placed, "placed")
    trees = placed.groupBy(key).agg(F.min("_rank").alias("_start"), F.sum("_count").alias("_size"), F.lit(1).cast("long").alias("_one"))
    trees = materialize(_ranked(materialize(trees, "keys"), ["_start"], "_one").drop("_one").withColumnRenamed("_rank", "_tree"), "trees")
    leaves = null_safe_join(placed, trees, [key]).withColumn("_first", F.col("_rank") - F.col("_start")).drop("_rank", "_start")
    leaves = materialize(leaves, "leaves")
    count, largest = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("_size"), F.lit(0))).first()
    as_leaves = leaves.withColumn("_digest", F.col(leaf))
    nodes = _raised(as_leaves, largest, height)
    trees = materialize(_roots(trees.drop("_start"), as_leaves, nodes), "roots")
    one = F.lit(1).cast("long")
    tops = trees.select(F.lit(TOP).cast("long").alias("_tree"), F.lit(count).cast("long").alias("_size"), F.col("_tree").alias("_first"), one.alias("_count"), "_digest")
    return Manifest(leaves, nodes.union(_raised(tops, count, height)), trees, count, leaf, height)


def root(manifest: Manifest) -> str | None:
    """The root of all; None for an empty dataset."""
    if manifest.count < 2:
        found = manifest.trees.select("_digest").first()
    else:
        found = manifest.nodes.where(F.col("_of") == TOP).orderBy(F.desc("_level")).select("_digest").first()
    return found and found[0]


# --- proofs -----------------------------------------------------------------------------------------------------------


def missing(known: np.ndarray, size: int) -> list[np.ndarray]:
    """Per level, the places of the siblings that the leaves at ``known`` (ascending, distinct) do not give."""
    out = []
    while size > 1:
        beside = known ^ 1
        out.append(beside[(beside < size) & ~np.isin(beside, known)])
        known, size = np.unique(known >> 1), -(-size // 2)
    return out


def _asked(trees: int):
    def run(table: pa.Table) -> pa.Table:
        tree, block, size = (table[c][0].as_py() for c in ("_tree", "_block", "_size"))
        known = np.unique(ranges(np.asarray(table["_from"]), np.asarray(table["_number"])))
        parts = [(tree, k, at) for k, at in enumerate(missing(known, size))]
        parts += [(TOP, k, at) for k, at in enumerate(missing(np.array([tree]), trees))]
        sizes = [len(at) for *_, at in parts]
        places = np.concatenate([at for *_, at in parts]) if parts else np.zeros(0, np.int64)
        own = [pa.array(np.repeat(np.array([p[k] for p in parts], np.int64), sizes), pa.int64()) for k in range(2)]
        n = len(places)
        columns = [pa.array([tree] * n, pa.int64()), pa.array([block] * n, pa.int64()), own[0], own[1].cast(pa.int32())]
        return pa.table([*columns, pa.array(places, pa.int64())], names=["_tree", "_block", "_of", "_level", "_at"])

    return run


def climb(known: dict[int, str], size: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """Digests by place for each level below the root, and the root: own nodes, fetched ones and what both give."""
    levels: list[dict[int, str]] = []
    while size > 1:
        level = len(levels)
        whole = dict(known)
        up: dict[int, str] = {}
        for at in known:
            beside = at ^ 1
            if beside < size and beside not in whole:
                whole[beside] = fetched[level, beside]
            if at >> 1 not in up:
                left = at & ~1
                up[at >> 1] = digest(whole[left], whole[left + 1]) if left + 1 < size else digest(whole[left])
        levels.append(whole)
        known, size = up, -(-size // 2)
    return levels, known[0]


def _expand(trees: int, leaf: str, names: list[str]):
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        number = np.asarray(leaves["_number"])
        rows = leaves.take(pa.array(np.repeat(np.arange(len(number)), number)))
        places = ranges(np.asarray(leaves["_from"]), number)
        tree, size = leaves["_tree"][0].as_py(), leaves["_size"][0].as_py()
        got: dict[int, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
        for of, level, at, held in zip(*(fetched[c].to_pylist() for c in ("_of", "_level", "_at", "_digest"))):
            got[of][level, at] = held
        levels, subroot = climb(dict(zip(places.tolist(), rows[leaf].to_pylist())), size, got[tree])
        above, top = climb({tree: subroot}, trees, got[TOP])
        beside = [list(map(level.get, ((places >> k) ^ 1).tolist())) for k, level in enumerate(levels)]
        shared = [s for k, level in enumerate(above) if (s := level.get((tree >> k) ^ 1)) is not None]
        proofs = [[s for s in own if s is not None] + shared for own in zip(*beside)] if beside else [shared] * len(places)
        n = len(places)
        added = {
            "_place": pa.array(places, pa.int64()), "_trees": pa.array([trees] * n, pa.int64()), "_subroot": pa.array([subroot] * n),
            "_root": pa.array([top] * n), "_proof": pa.array(proofs, pa.list_(pa.string())),
        }
        return pa.table([*(rows[c] for c in names), *added.values()], names=[*names, *added])

    return run


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Each leaf row with _tree, _size, _place, _trees (which give the sides of its siblings), _subroot, _root and _proof
    (the siblings from the leaf up, those that exist). ``wanted`` is a part of ``manifest.leaves``; all by default."""
    leaves = manifest.leaves if wanted is None else wanted
    dealt = _dealt(leaves, manifest.height)
    asked = dealt.select("_tree", "_size", "_block", "_from", "_number").groupBy("_tree", "_block").applyInArrow(
        _asked(manifest.count), "_tree long, _block long, _of long, _level int, _at long"
    )
    place = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1))
    ground = manifest.leaves.select(F.col("_tree").alias("_of"), F.lit(0).alias("_level"), place.alias("_at"), F.col(manifest.leaf).alias("_digest"))
    tops = manifest.trees.select(F.lit(TOP).cast("long").alias("_of"), F.lit(0).alias("_level"), F.col("_tree").alias("_at"), "_digest")
    store = manifest.nodes.unionByName(tops).unionByName(ground)
    fetched = materialize(materialize(asked, "asked").join(store, ["_of", "_level", "_at"]), "fetched")
    names = [c for c in leaves.columns if c not in ("_first", "_count")]
    kinds = leaves.select(*(F.col(f"`{c}`") for c in names)).schema
    pairs = dealt.groupBy("_tree", "_block").cogroup(fetched.groupBy("_tree", "_block"))
    return pairs.applyInArrow(_expand(manifest.count, manifest.leaf, names), extended(kinds, PROOF))


def folded(leaf: str, place: int, size: int, tree: int, trees: int, proof: list[str]) -> str:
    """The root that a leaf digest and its siblings give."""
    left = iter(proof)
    for at, width in ((place, size), (tree, trees)):
        while width > 1:
            if at ^ 1 >= width:
                leaf = digest(leaf)
            else:
                leaf = digest(next(left), leaf) if at & 1 else digest(leaf, next(left))
            at, width = at >> 1, -(-width // 2)
    return leaf


def fold(proved: DataFrame, leaf: str, out: str = "_folded") -> DataFrame:
    """Add ``out``, the root recomputed from the digest in ``leaf`` and the row's own proof."""
    inputs = (leaf, "_place", "_size", "_tree", "_trees", "_proof")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            yield with_columns(batch, {out: pa.array(list(map(folded, *columns)), pa.string())})

    return proved.mapInArrow(run, extended(proved.schema, f"{out} string"))
