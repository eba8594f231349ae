"""Groups of near duplicates by DataFrame functions alone.

The groups are those of ``ngram_join``: a text is the set of its 5-word shingles (of all its words if it has fewer), two
texts are near if their sets' Jaccard similarity reaches the threshold, and a group is a connected component. MinHash
bands of the same number propose, full sets decide. Links are not counted, so pairs within a group need not be checked
once they are known to be in one.

Equal sets are one node, named by a 64-bit hash of the set. The nodes of a band hash are a bucket. A shingle that no other
node of the buckets has is in no common part, so what a node shares with others bounds its similarity to any of them: nodes
that cannot reach the threshold go before any comparison, and of two nodes the one that shares less decides whether they are
compared. Texts that have a long passage in common and enough of their own are bucket mates, but no pair.

Each round the nodes of a bucket are compared with one of them, its centre (first the one that shares most), unless they are
in the centre's group already; buckets within one group are done, so a group of thousands of near copies takes rows in
proportion to its nodes. The rows of open buckets are written once a round. When few pairs of different groups are left in
the buckets, or a round has not halved them, all that are left and can be near are compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .components import components
from .ngram_join import RECALL, ROWS, THRESHOLD, WORDS, bands_for

#: Pairs left in open buckets, for each row of the buckets, that are compared without another round of centres.
PAIRS_PER_ROW = 4
_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HALF = (1 << 32) - 1
NODE = ["node", "n", "k", "label"]


def shingle_sets(docs: DataFrame, row: Column, text: Column, size: int = WORDS) -> DataFrame:
    """Columns row, node, n, set (sorted distinct shingle hashes) of the rows that have a word."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    found = F.filter(F.split(lower, _OUTSIDE), lambda w: w != "")
    hashed = docs.select(row.alias("row"), F.transform(found, lambda w: F.xxhash64(w)).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    shingles = F.transform(starts, lambda k: F.xxhash64(F.slice("words", k, size)))
    sets = hashed.select("row", F.sort_array(F.array_distinct(shingles)).alias("set"))
    return sets.select("row", F.xxhash64("set").alias("node"), F.size("set").cast("long").alias("n"), "set")


def band_rows(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """Columns node, n, band: each node's band hashes."""
    each = sets.select("node", "n", F.explode("set").alias("shingle"))
    least = []
    for k in range(0, bands * rows, 2):  # one hash gives two functions
        both = F.xxhash64(F.lit(k), F.col("shingle"))
        least += [F.min(both.bitwiseAND(F.lit(_HALF))).alias(f"m{k}"), F.min(F.shiftrightunsigned(both, 32)).alias(f"m{k + 1}")]
    signed = each.groupBy("node", "n").agg(*least)
    hashes = [F.xxhash64(F.lit(b), *(F.col(f"m{b * rows + r}") for r in range(rows))) for b in range(bands)]
    return signed.select("node", "n", F.explode(F.array(*hashes)).alias("band"))


def _alike(held: Column, other: Column, n: Column, other_n: Column, threshold: float) -> Column:
    """Whether sets of n shingles can be near, of which no more than ``held`` and ``other`` are in other sets."""
    both = F.least(held, other)
    return both >= F.lit(threshold) * (n + other_n - both) - F.lit(1e-9)


def _held_shingles(nodes: DataFrame, threshold: float) -> DataFrame:
    """Columns node, k (shingles that are in other sets of ``nodes``, too) of the nodes that so many allow to have near ones."""
    each = nodes.select("node", F.explode("set").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("node")).where("many = 1")
    own = own.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    counted = nodes.select("node", F.size("set").cast("long").alias("n")).join(own, "node", "left")
    counted = counted.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("k"))
    return counted.where(_alike(F.col("k"), F.col("k"), F.col("n"), F.col("k"), threshold)).select("node", "k")


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b, a_label, b_label) of nodes whose sets reach the threshold."""
    # merged at every size: sets grow with the input, so they are never broadcast
    of = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set")).hint("merge")
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    joined = joined.withColumn("both", F.size(F.array_intersect("a_set", "b_set")))
    union = F.size("a_set") + F.size("b_set") - F.col("both")
    near = (F.col("both") > 0) & (F.col("both") >= F.lit(threshold) * union - F.lit(1e-9))
    return materialize(joined.where(near).select("a", "b", "a_label", "b_label"), "near-pairs")


def _star_pairs(held: DataFrame, number: int, threshold: float) -> DataFrame:
    """Pairs of the nodes of each bucket with its centre, in other groups than the centre's."""
    # first the node with the least of its own, as the others are most like it
    order = F.struct(F.lit(0.0) if number else -F.col("k") / F.col("n"), F.xxhash64(F.lit(number), F.col("node")))
    return _pairs(held, held.groupBy(F.col("band").alias("of")).agg(*(F.min_by(c, order).alias(f"b_{c}") for c in NODE)), threshold)


def _all_pairs(held: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes that share a bucket but no group."""
    other = held.select(F.col("band").alias("of"), *(F.col(c).alias(f"b_{c}") for c in NODE))
    return _pairs(held, other, threshold, F.col("node") < F.col("b_node"))


def _pairs(held: DataFrame, other: DataFrame, threshold: float, also: Column | None = None) -> DataFrame:
    met = (F.col("band") == F.col("of")) & (F.col("label") != F.col("b_label"))
    met &= _alike(F.col("k"), F.col("b_k"), F.col("n"), F.col("b_n"), threshold)
    pairs = held.join(other, met if also is None else met & also)
    return pairs.select(F.col("node").alias("a"), F.col("b_node").alias("b"), F.col("label").alias("a_label"), "b_label").distinct()


def _open(held: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of buckets with more than one group, how many there are, and how many pairs of groups' nodes they hold."""
    parts = held.groupBy("band", "label").agg(F.count(F.lit(1)).alias("many"))
    buckets = parts.groupBy(F.col("band").alias("of")).agg(
        F.sum("many").alias("all"), F.sum(F.col("many").cast("double") * F.col("many")).alias("within"), F.count(F.lit(1)).alias("groups")
    )
    buckets = materialize(buckets.where("groups > 1"), "open-buckets")
    rows, pairs = buckets.agg(F.sum("all"), F.sum((F.col("all").cast("double") * F.col("all") - F.col("within")) / 2)).first()
    still = held.join(buckets.select("of"), F.col("band") == F.col("of"), "left_semi")
    return materialize(still, "open-rows") if rows else held, rows or 0, pairs or 0


def groups_of(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Columns node and label for the nodes that may have near ones: equal labels are one group."""
    nodes = sets.select("node", "set").dropDuplicates(["node"])
    keyed = materialize(band_rows(sets, bands_for(threshold, recall, rows), rows), "bands")
    shared = keyed.groupBy(F.col("band").alias("of")).agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    keyed = materialize(keyed.join(shared, F.col("band") == F.col("of"), "left_semi"), "shared-bands")
    nodes = materialize(nodes.join(keyed.select("node").distinct(), "node", "left_semi"), "bucket-sets")
    live = materialize(_held_shingles(nodes, threshold), "live-nodes")
    held = materialize(keyed.join(live, "node").withColumn("label", F.col("node")), "buckets")
    labels = materialize(live.select("node", F.col("node").alias("label")), "labels")
    number, before = 0, float("inf")
    while True:
        still, size, pairs = _open(held)
        if not size:
            return labels
        last = pairs <= PAIRS_PER_ROW * size or pairs > before / 2
        near = _near(_all_pairs(still, threshold) if last else _star_pairs(still, number, threshold), nodes, threshold)
        if linked := not near.isEmpty():
            moved = components(near.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
            moved = moved.select(F.col("id").alias("label"), F.col("label").alias("to"))
            renamed = lambda df: df.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
            labels = materialize(renamed(labels).select("node", "label"), "labels")
        if last:
            return labels
        if linked:
            held = materialize(renamed(still), "buckets")
        number, before = number + 1, pairs


def near_copies(docs: DataFrame, row: Column, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns _member, _page: the rows that have near copies, and the least row of their group."""
    sets = materialize(shingle_sets(docs, row, F.col(text_col).cast("string")), "shingle-sets")
    labels = groups_of(sets, threshold)
    member = sets.select("row", "node").join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("label"))
    pages = member.groupBy("label").agg(F.min("row").alias("page"), F.count(F.lit(1)).alias("many")).where("many > 1")
    found = member.join(pages, "label").groupBy(F.col("row").alias("_member")).agg(F.min("page").alias("_page"))
    return materialize(found, "copies")
