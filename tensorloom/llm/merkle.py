"""Merkle manifest of a table, with a proof for every row.

Leaves are ordered within their group by ranges, and cut into aligned blocks of
``2 ** BLOCK`` leaves. A block's root is hashed by one task, and blocks are leaves of the
level above, until one node a group is left. Proofs come down the same way: within
a block a fractal traversal emits the authentication paths of successive leaves, and
each block takes over the proof of its root from the level above.

The traversal keeps, for each band of ``BAND`` heights, the existing subtree that the
present leaf is in, and the desired one next to it, which grows by one leaf a round
with a stack of unfinished nodes; when a leaf range ends, the desired subtree has just
been finished and takes the place of the existing one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import blocks_of, few, in_order, pick, stored, table

#: Binary logarithm of a block's leaves, and heights of a subtree.
BLOCK, BAND = 10, 5


def node(*children: str) -> str:
    """H of a run: lowercase hex SHA-256 of its digests as text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Subtree:
    """The nodes from height ``low`` up to ``top`` above the leaves of place ``index``,
    grown leaf by leaf; a node without a neighbour is hashed alone."""

    def __init__(self, leaves: Sequence[str], index: int, low: int, top: int) -> None:
        self.leaves, self.low, self.top = leaves, low, top
        self.at, self.end = index << top, min((index + 1) << top, len(leaves))
        self.stack: list[tuple[int, int, str]] = []
        self.nodes: dict[tuple[int, int], str] = {}
        self.root: str | None = None

    def _push(self, height: int, place: int, digest: str) -> None:
        if self.low <= height < self.top:
            self.nodes[height, place] = digest
        if height == self.top:
            self.root = digest
        else:
            self.stack.append((height, place, digest))

    def grow(self) -> None:
        """One leaf more; after the last one the right edge is closed."""
        if self.at >= self.end:
            return
        self._push(0, self.at, self.leaves[self.at])
        self.at += 1
        last = self.at == self.end
        while self.stack:
            height, place, digest = self.stack[-1]
            if place & 1 and len(self.stack) > 1 and self.stack[-2][:2] == (height, place - 1):
                left = self.stack[-2][2]
                del self.stack[-2:]
                self._push(height + 1, place >> 1, node(left, digest))
            elif last:
                self.stack.pop()
                self._push(height + 1, place >> 1, node(digest))
            else:
                break

    def grown(self) -> Subtree:
        while self.at < self.end:
            self.grow()
        return self


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return (n - 1).bit_length()


def paths(leaves: Sequence[str], height: int, band: int = BAND) -> Iterator[list[str]]:
    """The authentication path of each leaf in turn, up to ``height``.

    An entry a level: ``L`` or ``R``, for the side of the sibling, and its digest, or
    ``-`` where there is none. Of nodes, two subtrees a band and their stacks are held.
    """
    n = len(leaves)
    bands = [(low, min(low + band, height)) for low in range(0, height, band)]
    existing = [Subtree(leaves, 0, low, top).grown() for low, top in bands]
    desired = [Subtree(leaves, 1, low, top) for low, top in bands]
    for t in range(n):
        out = []
        for (low, top), tree in zip(bands, existing, strict=True):
            for k in range(low, top):
                place = t >> k
                sibling = tree.nodes.get((k, place ^ 1))
                out.append("-" if sibling is None else ("L" if place & 1 else "R") + sibling)
        yield out
        for b, (low, top) in enumerate(bands):
            desired[b].grow()
            if (t + 1) % (1 << top) == 0:
                existing[b], desired[b] = desired[b], Subtree(leaves, ((t + 1) >> top) + 1, low, top)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    sibling = lambda s: F.substring(s, 2, 64)
    step = lambda at, s: F.when(s.startswith("L"), F.concat(sibling(s), at)).when(s.startswith("R"), F.concat(at, sibling(s))).otherwise(at)
    return F.aggregate(path, start, lambda at, s: F.sha2(step(at, s), 256))


def proof_digest(path: Column) -> Column:
    """H of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks whole and in order, one after another, in some task."""
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (g, block), rows in blocks_of(batches, 2):
        leaves = rows.column("digest").to_pylist()
        height = height_of(len(leaves))
        least = full = Subtree(leaves, 0, height, height).grown().root
        for _ in range(height, BLOCK):
            full = node(full)
        yield pa.RecordBatch.from_pylist([{"g": g, "block": block, "least": least, "full": full}])


def _ascend(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """``g, pos, digest`` of each level of blocks, and the groups that end at each, as ``g, digest``.

    A group ends where it has one block: its root is the lowest single node.
    """
    levels, ended = [], []
    while True:
        levels.append(nodes)
        light = nodes.select("g", F.shiftright("pos", BLOCK).alias("block"), "pos", "digest")
        blocks = stored(_dealt(light).mapInArrow(_roots, "g string, block long, least string, full string"))
        last = stored(blocks.groupBy("g").agg(F.max("block").alias("last")))
        blocks = blocks.join(few(last), "g")
        ended.append(blocks.where("last = 0").select("g", F.col("least").alias("digest")))
        nodes = stored(blocks.where("last > 0").select("g", F.col("block").alias("pos"), F.col("full").alias("digest")))
        if nodes.isEmpty():
            return levels, ended


def _traversal(kept: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in blocks_of(batches, 2):
            rows, above, only = found.slice(1), found.column("above")[0].as_py(), found.column("only")[0].as_py()
            leaves = rows.column("digest").to_pylist()
            proofs = [p + above for p in paths(leaves, height_of(len(leaves)) if only else BLOCK)]
            yield from rows.select(["g", "pos", "digest", *kept]).append_column("path", pa.array(proofs, pa.list_(pa.string()))).to_batches()

    return run


def _descend(levels: list[DataFrame], ended: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's rows with the ``path`` of each; ``tops`` has those of the groups' roots, as ``g, above``."""
    found = None
    for nodes, groups in zip(reversed(levels), reversed(ended), strict=True):
        heads = groups.join(few(tops), "g").select("g", F.lit(0).cast("long").alias("block"), "above", F.lit(True).alias("only"))
        if found is not None:
            heads = heads.unionByName(found.select("g", F.col("pos").alias("block"), F.col("path").alias("above"), F.lit(False).alias("only")))
        heads = heads.withColumn("pos", F.lit(-1).cast("long"))
        rows = nodes.withColumn("block", F.shiftright("pos", BLOCK)).unionByName(heads, allowMissingColumns=True)
        kept = [c for c in nodes.columns if c not in ("g", "pos", "digest")]
        order = ["g", "block", "pos", "digest", "above", "only", *kept]
        schema = ", ".join(["g string, pos long, digest string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in kept], "path array<string>"])
        found = _dealt(rows.select(*order)).mapInArrow(_traversal(kept), schema)
    return found


def manifest(df: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, path`` and the columns of ``extra``.

    A leaf is H of the ``fields``. In each group leaves ascend by id, null first, rows
    with equal ids by their leaf; every two consecutive nodes become their H, a last one
    alone too, until one is left, the ``subroot``. Subroots by group, null first, then by
    its UTF-8 bytes, likewise give the ``root``. ``path`` has an entry a level, see
    ``paths``; ``folded`` and ``proof_digest`` work on it. ``extra`` maps names to
    expressions over ``in_<field>`` columns, worked out where leaves are.

    Nulls are leaves' ``-``; texts are hashed whole; repeated rows are a leaf each.
    An empty table gives no rows. Columns not named are not read.
    """
    kept = {"doc_id": F.col("id_"), **(extra or {})}
    src = pick(df, id_=id_col, g_=group_col, **{f"in_{c}": c for c in fields})
    group = F.coalesce(F.concat(F.lit("="), F.col("g_").cast("string")), F.lit(""))
    named = {f"x{k}": c for k, c in enumerate(kept.values())}
    rows = table(src.select(group.alias("g"), F.col("id_").alias("order"), leaf(*[F.col(f"in_{c}") for c in fields]).alias("digest"), *[c.alias(n) for n, c in named.items()]), "leaves")
    placed = in_order(rows, F.col("g"), F.col("order").asc_nulls_first(), F.col("digest"), name="place")
    first = stored(placed.groupBy("g").agg(F.min("place").alias("first")))
    leaves = placed.join(few(first), "g").select("g", (F.col("place") - F.col("first")).alias("pos"), "digest", *named)
    levels, ended = _ascend(leaves)
    subroots = ended[0]
    for more in ended[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots)
    top = in_order(subroots, F.col("g"))
    over, whole = _ascend(top.select(F.lit("").alias("g"), "pos", "digest", F.col("g").alias("group")))
    root = whole[-1].select(F.col("digest").alias("root"))
    start = df.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast("array<string>").alias("above"))
    tops = stored(_descend(over, whole, start).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("above")))
    found = _descend(levels, ended, tops.drop("subroot"))
    found = found.join(few(tops.drop("above")), "g").crossJoin(F.broadcast(root))  # one row
    return found.select(*[F.col(n).alias(c) for n, c in zip(named, kept, strict=True)], F.col("digest").alias("leaf"), "subroot", "root", "path")
