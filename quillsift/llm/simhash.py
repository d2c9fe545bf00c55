"""SimHash near-duplicate groups, linked through BK-trees.

Fingerprints are made in one pass over the texts; from there on only distinct fingerprints move. Two
fingerprints that differ in at most r bits agree on at least two of r + 2 blocks of bits, so each is sent to the
shard of every pair of blocks (26 bits of agreement at r = 3). A shard builds a BK-tree whose children are keyed
by their integer Hamming distance to the parent and follows only the edges within the radius. A shard over
`shard_rows` fingerprints is dealt out again: of r + 1 parts of its other bits two linked fingerprints agree on one at least. After DEPTH
rounds 11 bits are left at most (r = 3), so no shard can hold more than 2048 fingerprints, however many there are. Trees are
handed out by the shuffle instead of a broadcast, as a broadcast would gather
all fingerprints on the driver. A shard returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, tidy
from .components import components

SHARD_ROWS = 4096
#: How often a shard that is too large is dealt out again.
DEPTH = 5


def fingerprint(text: str | bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words. A text may come as UTF-8."""
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    left = total = max(1, len(words) - width + 1)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while left:
        n = min(left, 1 << 15)
        hashes = np.fromiter((digest(s, seed) for s in islice(shingles, n)), np.uint64, n)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= n
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, bits, mark): one row for each row of `docs`, bits as a signed long, mark the text's hash as xxhash64() has it. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            bits = np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, batch.num_rows)
            marks = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64)), pa.array(marks.view(np.int64))], names=["doc_id", "bits", "mark"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, bits long, mark long")


class BKTree:
    """Fingerprints by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, own = 0, len(self.values) - 1
        while own:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = own
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at `radius` or less."""
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            low, high = d - radius, d + radius
            todo += [below for k, below in children[at].items() if low <= k <= high]


def _forest(values: list[int], nodes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in a shard."""
    parent = list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    tree = BKTree()
    for k, value in enumerate(values):
        for near in tree.within(value, radius):
            x, y = root(k), root(near)
            if x != y:
                parent[max(x, y)] = min(x, y)
        tree.add(value)
    for k in range(len(values)):
        if (r := root(k)) != k:
            yield nodes[k], nodes[r]


def _shard_links(radius: int):
    """Batches (kind, key, bits, node), sorted by shard, to batches of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            if not len(rows[0]):
                continue
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            starts = np.concatenate([[0], new])
            kept = [x[starts[-1] :] for x in rows]
            if out := list(_groups(rows, starts[:-1], starts[1:], radius)):
                yield _links(out)
        if kept is not None:
            yield _links(list(_groups(kept, np.array([0]), np.array([len(kept[0])]), radius)))

    return run


def _groups(rows: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    for a, b in zip(starts, ends):
        if b - a > 1:
            yield from _forest([int(x) for x in rows[2][a:b].astype(np.int64).view(np.uint64)], rows[3][a:b].tolist(), radius)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _parts(bits: list[int], n: int) -> list[int]:
    """`bits` in n runs of like length, each as a mask."""
    edges = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:c]) for a, c in zip(edges, edges[1:])]


def shard_masks(radius: int, depth: int) -> list[list[int]]:
    """By round, the bits on which a shard agrees, by kind of shard; kind k comes of kind k // (radius + 1) of the round before."""
    out = [[a | b for a, b in combinations(_parts(list(range(64)), radius + 2), 2)]]
    for _ in range(depth):
        out.append([m | p for m in out[-1] for p in _parts([b for b in range(64) if not m >> b & 1], radius + 1)])
    return out


def link_fingerprints(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) that span every pair of `distinct`(bits, node) at `radius` or less."""
    ship(distinct.sparkSession)
    masks = shard_masks(radius, depth)
    dealt = distinct.select("bits", "node", F.explode(F.sequence(F.lit(0), F.lit(len(masks[0]) - 1))).alias("kind"))
    ready, level = [], 0
    while True:
        signed = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks[level])), ",").cast("array<bigint>")
        dealt = dealt.select("bits", "node", "kind", F.col("bits").bitwiseAND(F.get(signed, F.col("kind"))).alias("key"))
        if level == depth:
            break
        hot = settle(dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).drop("n"))
        if not hot.head(1):
            break
        ready.append(dealt.join(hot, ["kind", "key"], "left_anti").select(F.lit(level).alias("level"), "kind", "key", "bits", "node"))
        below = F.sequence(F.col("kind") * (radius + 1), F.col("kind") * (radius + 1) + radius)
        dealt = settle(dealt.join(hot, ["kind", "key"], "left_semi").select("bits", "node", F.explode(below).alias("kind")))
        level += 1
    rows = dealt.select(F.lit(level).alias("level"), "kind", "key", "bits", "node")
    for part in ready:
        rows = rows.union(part)
    shards = rows.select((F.col("level") * len(masks[-1]) + F.col("kind")).alias("kind"), "key", "bits", "node")
    return shards.repartition("kind", "key").sortWithinPartitions("kind", "key", "bits").mapInArrow(tidy(_shard_links(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_rows, component, mark) for every row of `docs`.

    component_id is the smallest id reachable over links of `radius` differing bits or fewer, itself included;
    group_rows counts the rows of the fingerprint, component is the component's least fingerprint as a signed long. Nulls and texts without words have fingerprint zero and are linked
    like any other; rows with a null id link others, but name no group: where all rows of a group have none, component_id is null. Repeated rows stay
    repeated. Other columns are ignored; an empty table gives an empty table.
    """
    own = settle(fingerprints(docs, id_col, text_col, width, seed))
    distinct = settle(own.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("group_rows")))
    found = components(link_fingerprints(distinct.select("bits", F.col("bits").alias("node")), radius, shard_rows))
    linked = distinct.join(found.select(F.col("node").alias("bits"), "component"), "bits")
    # groups of one fingerprint are the rule; only the others are named through their members
    names = settle(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    many = settle(linked.select("bits", "component").join(names, "component").select("bits", "component", "component_id"))
    own_name = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id"))
    classes = distinct.join(many, "bits", "left").select("bits", "group_rows", own_name.alias("component_id"), F.coalesce("component", "bits").alias("component"))
    return own.join(settle(classes), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "group_rows", "component", "mark"
    )
