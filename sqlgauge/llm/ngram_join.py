"""Near duplicates: MinHash banding proposes, full n-gram sets decide.

A document is the set of its 5-word shingles (of all its words if it has fewer). Documents with equal sets are one node
that remembers its copies. Bands and rows follow from the wanted recall at the threshold (``bands_for``); nodes that
share a band hash are tied to the smallest node of that hash, and the ties' connected components are the candidate
groups. Small groups share buckets and are checked whole. A large group is cut into blocks along the parts that
formed it, and only blocks that share a band hash meet: a long chain of groups takes work in proportion to its length,
and every pair that shares a band is checked. Each pair of blocks is one task, so no task holds more than two blocks and
no pair is a row. A task counts the shared shingles of all its pairs, and gives back each node's links and a spanning
tree of the linked nodes. Classes are the components of those trees.

Documents without words have no links and are their own class. Rows with equal ids are taken as one document; if their
texts differ and both have near copies, the set whose bytes come first is compared. Null ids take part, with a hash of
the text in place of an id; a class's id is its smallest id that is not null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import prepared, ranges, slices, tidy
from .components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
BLOCK_NODES = 500
BLOCK_SHINGLES = 1 << 20
#: A product takes a cell of a tile in about this share of the time that a list takes for one of its pairs.
PRODUCT_GAIN = 32
TILE_CELLS = 1 << 22

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` hashes that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and how many each text has."""
    raw = [t.encode().lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = _INSIDE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    document = np.searchsorted(bounds, start, side="right") - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    length = end - start
    at = ranges(start, length)
    inner = at - np.repeat(start, length)
    signed = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[inner % 4096]
    word = _mix(np.add.reduceat(signed, np.cumsum(length) - length) + length.astype(np.uint64))
    counts = np.bincount(document, minlength=len(texts))
    width = np.minimum(counts, size)
    n = np.where(counts > 0, counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    place = ranges(first, n)
    take = np.repeat(width, n)
    value = take.astype(np.uint64)
    for k in range(size):
        live = k < take
        value = np.where(live, _mix(value * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(place + k, len(word) - 1)]), value)
    sets, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for k, many in enumerate(n.tolist()):
        if many:
            own = np.unique(value[at : at + many])
            sets.append(own)
            sizes[k] = len(own)
            at += many
    return np.concatenate(sets), sizes


def _band_hashes(sets: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts with shingles only, bands)."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    seeds = np.random.default_rng(7).integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(bands):
        value = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            hashed = sets * seeds[b, r]
            hashed ^= hashed >> np.uint64(31)
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, starts))
        out[:, b] = value
    return out


SKETCH = "doc_id long, row long, n long, class binary, bands array<long>"


def _sketch_step(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets, sizes = shingle_sets(batch.column(1).to_pylist(), size)
            found = iter(_band_hashes(sets, sizes, bands, rows).view(np.int64).tolist())
            ends = np.cumsum(sizes).tolist()
            classes = [hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                    pa.array([next(found) if n else [] for n in sizes.tolist()], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "n", "class", "bands"],
            )

    return run


CARRIED = ["id", "comp", "block", "meets", "alone", "copies"]
SETS = "id long, comp long, block int, meets array<int>, alone boolean, copies long, shingles binary"


def _sets_step(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets, sizes = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), size)
            ends = np.cumsum(sizes).tolist()
            blobs = [sets[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in CARRIED]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], names=[*CARRIED, "shingles"])

    return run


def _shared_common(row: np.ndarray, column: np.ndarray, n: int, kind: type) -> np.ndarray:
    """How many columns each two of ``n`` rows share, by products of tiles of columns; ``column`` ascends."""
    shared = np.zeros((n, n), kind)
    width = max(1, TILE_CELLS // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        here = slice(*np.searchsorted(column, [low, low + width]))
        tile = np.zeros((n, int(column[here][-1]) + 1 - low), kind)
        tile[row[here], column[here] - low] = 1
        shared += tile @ tile.T
    return shared


def linked(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float, own: bool):
    """Links (partners with their copies) and tree root of each node; ``own``: pairs inside the one block, too.

    Shingles that many of the sets hold are counted by matrix products, the others along the lists of their holders."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(joined, kind="stable")
    value, holder = joined[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    number = np.cumsum(fresh) - 1
    held = np.bincount(number, minlength=1)
    common = held * held * PRODUCT_GAIN > n * n
    dense = common[number]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts stay exact
    shared = _shared_common(holder[dense], (np.cumsum(common) - 1)[number[dense]], n, kind)
    mine = np.empty(len(joined), np.int64)
    mine[order] = number
    first = (np.cumsum(held) - held)[mine]
    many = np.where(common, 0, held)[mine]
    links, root, at = np.zeros(n, np.int64), np.arange(n), 0
    for k in range(n):
        part = slice(at, at + sizes[k])
        at += sizes[k]
        both = shared[k] + np.bincount(holder[ranges(first[part], many[part])], minlength=n)
        near = (both > 0) & (both >= threshold * (sizes + sizes[k] - both) - 1e-9)
        near[k] = False
        if not own:
            near &= side != side[k]
        near = np.flatnonzero(near)
        if len(near):
            links[k] = copies[near].sum()
            touched = np.unique(np.append(root[near], root[k]))
            if len(touched) > 1:
                root[np.isin(root, touched)] = touched[0]
    return links, root


LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        comp, ids = np.asarray(group.column("comp")), np.asarray(group.column("id"))
        side, copies = np.asarray(group.column("block")), np.asarray(group.column("copies"))
        blobs = group.column("shingles").to_pylist()
        out = [[], [], []]
        order = np.array(sorted(range(len(ids)), key=lambda k: (comp[k], ids[k], blobs[k])))
        keep = np.ones(len(order), bool)  # repeated rows of one document count once
        keep[1:] = (ids[order][1:] != ids[order][:-1]) | (comp[order][1:] != comp[order][:-1])
        order = order[keep]
        cuts = np.flatnonzero(np.diff(comp[order])) + 1
        for part in np.split(order, cuts):
            links, root = linked(
                ids[part], side[part], copies[part], [np.frombuffer(blobs[k], np.uint64) for k in part], threshold, low == high
            )
            for held, value in zip(out, (ids[part], links, ids[part][root])):
                held.append(value)
        return pa.table([pa.array(np.concatenate(v), pa.int64()) for v in out], schema=LINKS)

    return run


def row_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells documents apart: the id, or a hash of the text where it is null."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(0), F.col(text_col)))


def _meeting_blocks(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Members of large groups with their block, and the blocks it ``meets``: those it shares a band hash with.

    ``member`` holds id, comp, path, copies, blocks, nodes. A node goes with the largest part of its group on its path
    that a block can hold; a first part that is larger is dealt to as many blocks as it takes."""
    parts = member.select("comp", F.posexplode("path").alias("round", "part"))
    crowds = parts.groupBy("comp", "round", "part").agg(F.count(F.lit(1)).alias("crowd"))
    fits = F.col("crowd") * F.col("blocks") <= F.col("nodes")
    steps = member.select("id", "comp", "copies", "blocks", "nodes", F.posexplode("path").alias("round", "part"))
    steps = steps.join(crowds, ["comp", "round", "part"]).where(fits | (F.col("round") == 0))
    homes = steps.groupBy("id", "comp", "copies", "blocks", "nodes").agg(
        F.max_by("part", "round").alias("home"), F.max_by("crowd", "round").alias("crowd"), F.max("round").alias("round")
    )
    dealt = F.pmod(F.xxhash64("id"), F.ceil(F.col("crowd") * F.col("blocks") / F.col("nodes")))
    block = F.pmod(F.pmod(F.xxhash64("home", "round"), F.col("blocks")) + dealt, F.col("blocks")).cast("int")
    placed = materialize(homes.select("id", "comp", "copies", block.alias("block")), "placed")
    # the blocks of one band: as many as there are blocks, however many nodes share it
    keyed = nodes.select("id", F.explode("bands").alias("band")).join(placed, "id").groupBy("comp", "band")
    bands = keyed.agg(F.sort_array(F.collect_set("block")).alias("all")).select("comp", "all").distinct()
    pairs = bands.select("comp", "all", F.explode("all").alias("block")).select("comp", "block", F.explode("all").alias("other"))
    meets = pairs.distinct().groupBy("comp", "block").agg(F.collect_set("other").alias("meets"))
    return placed.join(meets, ["comp", "block"]).select("id", "comp", "block", "meets", F.lit(False).alias("alone"), "copies")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: float = THRESHOLD,
    recall: float = RECALL, rows: int = ROWS,
) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of its component), n_copies (rows with an equal set, itself included),
    n_links (other rows at the threshold or above, copies included); _row and _first are the ``row_id`` of the row and
    of the document that stands for its class."""
    source = prepared(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        row_id(id_col, text_col).alias("row"),
    )
    bands = bands_for(threshold, recall, rows)
    sketch = materialize(source.mapInArrow(tidy(_sketch_step(size, bands, rows)), SKETCH), "sketch")
    # a node for each distinct set
    nodes = materialize(
        sketch.where("n > 0").groupBy("class", "bands")
        .agg(F.min("row").alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")),
        "nodes",
    )
    keyed = nodes.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("most")).where("centre < most")
    ties = keyed.join(shared.select("band", "centre"), "band").select(F.col("id").alias("b"), F.col("centre").alias("a"))
    groups = components(ties, path=True)
    member = groups.join(nodes.select("id", "copies", "n"), "id")  # path: see _meeting_blocks
    sums = member.groupBy(F.col("label").alias("comp")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    sums = sums.select(
        "comp", "nodes", "shingles",
        F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    sums = materialize(sums, "groups")
    total, large = sums.agg(F.sum(F.when(F.col("blocks") == 1, F.col("shingles"))), F.max("blocks")).first()
    buckets = max(64, (total or 0) // (BLOCK_SHINGLES // 2))
    member = member.select("id", F.col("label").alias("comp"), "path", "copies").join(sums.select("comp", "blocks", "nodes"), "comp")
    whole = F.array(F.lit(0)).cast("array<int>")
    held = member.where("blocks = 1").select(
        "id", "comp", F.lit(0).alias("block"), whole.alias("meets"), F.lit(True).alias("alone"), "copies"
    )
    if (large or 0) > 1:
        held = held.union(_meeting_blocks(nodes, materialize(member.where("blocks > 1"), "large-groups")))
    texts = (
        # merged at every size: the members grow with the input, so they are never broadcast
        source.join(materialize(held, "members").withColumnRenamed("id", "row").hint("merge"), "row")
        .select(F.col("row").alias("id"), "text", *CARRIED[1:])
    )
    sets = texts.mapInArrow(tidy(_sets_step(size)), SETS)
    grouped = sets.withColumn("other", F.explode("meets")).select(
        "id", "comp", "block", "copies", "shingles",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("alone"), F.pmod(F.xxhash64("comp"), F.lit(buckets))).otherwise(F.col("comp")).alias("bucket"), "alone",
    )
    found = materialize(
        grouped.groupBy("alone", "bucket", "low", "high").applyInArrow(_verify(threshold), "id long, links long, root long"),
        "links",
    )
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = (
        nodes.select("class", "id", "least", "copies")
        .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(labels, "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )
    info = materialize(info, "info")
    least = info.groupBy("label").agg(F.min("least").alias("class_id"), F.min("id").alias("first"))
    least = least.select("label", "class_id", F.coalesce("class_id", "first").alias("first"))
    info = materialize(info.join(least, "label").select("class", "class_id", "first", "copies", "links"), "classes")
    return sketch.select("doc_id", "row", "class").join(info, "class", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.col("row").alias("_row"), F.coalesce("first", "row").alias("_first"),
    )
