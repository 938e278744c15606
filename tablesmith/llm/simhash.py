"""Near duplicates by SimHash fingerprints, found in BK-trees.

Two fingerprints that differ in at most two of 64 bits agree in two of four 16-bit blocks. Each of
the six choices of two blocks shards the distinct fingerprints by their 32 bits there, and a shard
is a BK-tree: children hang on their Hamming distance to the parent, and a search follows only the
edges within the radius. A fingerprint meets only the trees it can have neighbours in, so none is
broadcast whole. Shards over a bound go another exact way, see ``_linked_by_centres``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import keep, one_of_each, row_key, text_of
from tablesmith.llm.components import connected_components

RADIUS = 2
TREE_NODES = 1024  # a larger shard is not put into one tree
_BLOCKS = 4
_CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The majority of the bits of the shingles' XXH64, repeats counted; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[width - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, v in enumerate(votes.tolist()) if 2 * v > len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` (identity of the row), ``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["key", "doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, f"key struct<a:long,b:long>, doc_id {kind}, fp long")


class BKTree:
    """Fingerprints by integer Hamming distance to their parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the nodes at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            stack.extend(children[e] for e in range(max(d - radius, 1), d + radius + 1) if e in children)
        return found

    def add(self, value: int) -> None:
        at = 0
        while at < len(self.values):
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})


def tree_links(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join exactly the fingerprints of a shard that neighbours connect, one less than nodes."""
    tree, root, links = BKTree(), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, p in enumerate(prints):
        root.append(i)
        for j in tree.within(p & (2**64 - 1), radius):
            if (r := find(j)) != (own := find(i)):
                root[own] = r
                links.append((p, prints[j]))
        tree.add(p & (2**64 - 1))
    return links


def _shards(prints: DataFrame) -> DataFrame:
    """Each fingerprint once for each choice of blocks that must agree."""
    width = 64 // _BLOCKS
    block = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(_BLOCKS)]
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(_BLOCKS), _BLOCKS - RADIUS))
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("shard"))


def _linked_by_trees(members: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, prints = None, []

        def links() -> pa.RecordBatch:
            found = tree_links(prints)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard:
                    if len(prints) > 1:
                        yield links()
                    shard, prints = s, []
                prints.append(p)
        if len(prints) > 1:
            yield links()

    return members.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(work, "a long, b long")


def _linked_by_centres(prints: DataFrame) -> DataFrame:
    """Links among fingerprints of shards too large for a tree, exact at any size.

    Two fingerprints are at most two bits apart exactly when some value is at most one bit from
    both. Each is listed under the 65 such values; a value has 65 members at most, all within two
    bits of each other, and hangs them on the least.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    centred = prints.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    groups = centred.groupBy("centre").agg(F.collect_set("fp").alias("members"), F.min("fp").alias("b")).where(F.size("members") > 1)
    return groups.select(F.explode("members").alias("a"), "b").where("a <> b").distinct()


def fingerprint_links(prints: DataFrame, tree_nodes: int = TREE_NODES, keep: Callable[[DataFrame, str], DataFrame] = keep) -> DataFrame:
    """Pairs (``a``, ``b``) that connect the same distinct fingerprints ``fp`` as all pairs within the radius."""
    shards = _shards(prints)
    sizes = shards.groupBy("shard").count().where("count > 1")
    members = keep(shards.join(sizes, "shard"), "shards")
    trees = _linked_by_trees(members.where(F.col("count") <= tree_nodes))
    large = members.where(F.col("count") > tree_nodes).select("fp").distinct()
    return trees.unionAll(_linked_by_centres(large))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_nodes: int = TREE_NODES) -> DataFrame:
    """``key``, ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``root`` for each row.

    ``component_id`` is the least id that links of at most two differing bits reach (null if all are
    null). Components of null ids or of one repeated id share it; ``root`` tells them apart. Equal fingerprints are one node, so a group of copies of any size costs one row in the
    search. Texts without words (null, empty, blank) have fingerprint zero and are linked like any
    other. Repeated rows get equal answers; an empty table gives an empty one.
    """
    of_rows = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = of_rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), tree_nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = keep(rooted, "rooted")
    # written, so that both sides of the join are plain exchanges and a root of many prints can be split
    components = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = rooted.join(components, "root").select("fp", "component_id", "root")
    return of_rows.join(named, "fp").select("key", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, chosen as in ``one_of_each``."""
    return one_of_each(docs, near_duplicate_groups(docs, id_col, text_col), "root", id_col, text_col)
