"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that may be near meet in buckets. There their bits are stored as
planes, one bitset for each of the 64 positions, and a query's distance to all
members grows by one exclusive-or and a carry-save addition a plane, for the whole
block at once. A block is abandoned as soon as every distance is over the radius.

For a radius of 2 the buckets are exact: the bits form four quarters, two changed
bits leave two of them whole, so near fingerprints share the values of one of six
pairs of quarters. Buckets over a limit are split by the same argument on the bits
left, whose 32 positions form three parts of which one stays whole; what then
shares a bucket differs in 22 bits at most, a bound that no input can exceed.

Near-duplicates by word shingles meet under MinHash keys instead, where a bucket over
the limit is dealt out by pairs of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import few, pick, stored, table, trimmed

BITS, SEED = 64, 42
#: Members of a bucket beyond which it is split.
SPLIT = 4096
#: Bands x rows of the MinHash keys under which word-shingle near-duplicates meet:
#: a pair of similarity 0.8 misses all of them once in 3000 times.
BANDS, BAND_ROWS = 20, 5


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of all ``size``-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


class BitSlices:
    """A block of fingerprints stored as vertical bit planes."""

    def __init__(self, prints: list[int]) -> None:
        self.n, self.all = len(prints), (1 << len(prints)) - 1
        raw = np.unpackbits(np.array(prints, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes = [int.from_bytes(np.packbits(raw[:, b], bitorder="little").tobytes(), "little") for b in range(BITS)]
        #: by bit position: members that differ from a query whose bit is 0, and 1
        self.differ = [(p, p ^ self.all) for p in planes]

    def near(self, query: int, radius: int, among: int | None = None) -> int:
        """Bitset of the members within ``radius`` of ``query``."""
        alive = self.all if among is None else among
        width = (radius + 1).bit_length()
        counters, over, differ = [0] * width, self.all ^ alive, self.differ
        for b in range(0, BITS, 2):
            x, y = differ[b][query >> b & 1], differ[b + 1][query >> (b + 1) & 1]
            # a full adder of two planes and the lowest counter; its carry ripples upward
            half = x ^ y
            carry = (x & y) | (half & counters[0])
            counters[0] ^= half
            for k in range(1, width):
                if not carry:
                    break
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 6:
                over |= self._above(counters, radius)
                if over == self.all:  # the block is abandoned
                    return 0
        return self.all & ~(over | self._above(counters, radius))

    def _above(self, counters: list[int], radius: int) -> int:
        """Members whose counter is over ``radius``: a comparison from the top bit down."""
        over, equal = 0, self.all
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                over |= equal & counters[k]
                equal &= ~counters[k]
        return over


def nearest_links(prints: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(i, j), j < i: links by which all members within ``radius`` hang together as by all links."""
    slices, root = BitSlices(prints), list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(1, len(prints)):
        found = slices.near(prints[i], radius, (1 << i) - 1)
        while found:
            j = (found & -found).bit_length() - 1
            found &= found - 1
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def _quarters(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF) for k in range(4)]


def _bucket_keys(prints: DataFrame) -> DataFrame:
    """``fp`` -> rows ``key, fp`` for each of the six pairs of quarters."""
    q = _quarters(F.col("fp"))
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(q[a], 16)).bitwiseOR(q[b]) for n, (a, b) in enumerate(combinations(range(4), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _split_keys(rows: DataFrame) -> DataFrame:
    """Rows of large buckets -> three rows each, keyed also by a part of the 32 bits left."""
    q = _quarters(F.col("fp"))
    rest = F.lit(None).cast("long")
    for n, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = [k for k in range(4) if k not in (a, b)]
        rest = F.when(F.shiftright("key", 32) == n, F.shiftleft(q[c], 16).bitwiseOR(q[d])).otherwise(rest)
    parts = [F.lit(k << 12).bitwiseOR(F.shiftright(rest, s).bitwiseAND(m)) for k, (s, m) in enumerate(((0, 0x7FF), (11, 0x7FF), (22, 0x3FF)))]
    return rows.select("fp", "key", F.explode(F.array(*parts)).alias("part"))


def _link_buckets(radius: int):
    """Rows ``key..., fp`` sorted by key -> links ``a, b`` (a > b) within each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prints = None, []

        def links() -> pa.RecordBatch:
            unsigned = [p & 0xFFFFFFFFFFFFFFFF for p in prints]
            pairs = [(max(prints[i], prints[j]), min(prints[i], prints[j])) for i, j in nearest_links(unsigned, radius)] if len(prints) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            *keys, fps = [c.to_pylist() for c in batch.columns]
            for key, fp in zip(zip(*keys, strict=True), fps, strict=True):
                if key != now:
                    if len(prints) > 1:
                        yield links()
                    now, prints = key, []
                prints.append(fp)
        if len(prints) > 1:
            yield links()

    return run


def links_of(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` (a > b) that connect all distinct fingerprints ``fp`` within ``radius`` (at most 2)."""
    if radius > 2:
        raise ValueError("the buckets hold for a radius of at most 2")
    rows = _bucket_keys(prints)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, "key"))
    small = shared.where(F.col("n") <= SPLIT).select("key", F.lit(0).alias("part"), "fp")
    large = _split_keys(shared.where(F.col("n") > SPLIT)).select("key", "part", "fp")
    dealt = small.unionByName(large).repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(_link_buckets(radius), "a long, b long").distinct()


#: Rows of links that a task should have at least.
TASK_ROWS = 100_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more tasks than these need, but one a core.

    The steps below are many and mostly small; each task of each would write files of its own.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """Links ``a, b`` -> ``node, root`` for every node with a link, root its component's smallest.

    Large-star and small-star steps in turn, each a minimum by node and a join, until
    nothing changes; the depth falls by half in each round. Steps are checkpointed.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(now)
    most = 2 * before[0]  # the steps below never have more links
    now = _packed(now, most)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _packed(_packed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), most).distinct(), most)
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _packed(large.join(lows, "a"), most).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        now = stored(_packed(small, most))
        after = print_of(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits) ``, component_id``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased;
    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits.

    Null and empty texts have fingerprint 0 and are linked like any other; a text
    shorter than a shingle is one shingle. Repeated rows share a fingerprint and a
    component. Null ids are passed on and ignored by the minimum. An empty table
    gives no rows; columns not named are not read.
    """
    src = pick(df, doc_id=id_col, text_=text_col).select(F.col("doc_id").cast("long"), F.col("text_").cast("string"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    printed = table(src.mapInArrow(prints, "doc_id long, fp long"), "fingerprints")
    distinct = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = stored(components(links_of(distinct.select("fp"), radius)))
    known = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    where = known.join(first, "root").select("fp", "component_id")
    return printed.join(where, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SKETCH = "row long, fp long, keys array<long>"


def _sketch(shingle: int, bands: int, band_rows: int):
    """Row and text -> its fingerprint and one MinHash key a band; texts without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dice = np.random.default_rng(SEED)
        n = bands * band_rows
        mul = dice.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = dice.integers(0, 1 << 63, n, dtype=np.uint64)
        for batch in batches:
            rows, fps, keys = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_hashes(text.as_py(), shingle)
                if not len(hashes):
                    continue
                least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
                distinct = np.unique(hashes)
                for at in range(0, len(distinct), 2048):
                    part = distinct[at : at + 2048, None] * mul + add
                    np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
                rows.append(row)
                fps.append(fingerprint(hashes))
                flat = least.tobytes()
                keys.append([xxhash.xxh64_intdigest(flat[k * 8 * band_rows : (k + 1) * 8 * band_rows], k) for k in range(bands)])
            signed = np.array(keys, dtype=np.uint64).reshape(-1, bands).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(list(signed), pa.list_(pa.int64()))], ["row", "fp", "keys"])

    return run


#: Shingles of a block's members beyond which it is split, where these come with their sets.
SPLIT_SHINGLES = 1 << 21
#: A round that links fewer than one in so many rows is the last of its kind; the whole buckets find the rest.
WORTHWHILE = 50
#: Distances at which a nearest neighbour is sought, up to the radius.
LADDER = (0, 2, 4, 8)


def _blocks(n: str, most: int) -> Column:
    """Blocks into which ``n`` are cut."""
    return F.ceil(F.col(n) / F.lit(most)).cast("int")


def _deal(rows: DataFrame, sizes: DataFrame, *more: str) -> DataFrame:
    """Members ``key, row, fp, comp`` and ``more`` of buckets of so many ``blocks`` -> the same, by bucket and part.

    Each pair of a bucket's blocks is a part: every two members meet in one, and no task
    holds more than two blocks.
    """
    held = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")
    dealt = other.select("key", part.alias("part"), "row", "fp", "comp", "block", *more)
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "row")


def _pairs_in_buckets(radius: int, n: int = 1):
    """Sorted parts -> ``a, b, key, step``: for each member, of the earlier ones (b) that are
    within ``radius`` and in another component, the ``n`` nearest."""
    ladder = [*[r for r in LADDER if r < radius], radius]

    def pairs(members: list[tuple]) -> Iterator[tuple[int, int, int]]:
        slices, own, of_block = BitSlices([m[1] & 0xFFFFFFFFFFFFFFFF for m in members]), {}, {}
        for i, m in enumerate(members):
            own[m[2]] = own.get(m[2], 0) | 1 << i
            of_block[m[3]] = of_block.get(m[3], 0) | 1 << i
        for i, (row, fp, comp, block) in enumerate(members):
            among = ((1 << i) - 1) & ~own[comp]
            if len(of_block) > 1:  # members of one block meet in the part of that block alone
                among &= ~of_block[block]
            place = 0
            for step, r in enumerate(ladder if among else ()):  # the closest are the likeliest to pass verification
                found = slices.near(fp & 0xFFFFFFFFFFFFFFFF, r, among)
                among &= ~found
                while found and place < n:
                    last = found.bit_length() - 1
                    found ^= 1 << last
                    yield row, members[last][0], step
                    place += 1
                if place == n:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        out: list[list[int]] = [[], [], [], []]

        def end_part() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                for a, b, step in pairs(members):
                    for column, x in zip(out, (a, b, now[0], step), strict=True):
                        column.append(x)
                    if len(out[0]) >= 50_000:
                        yield flush()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "key", "step"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for key, part, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, part) != now:
                    yield from end_part()
                    now, members = (key, part), []
                members.append(tuple(member))
        yield from end_part()
        yield flush()

    return run


def _with_candidates(radius: int):
    """Sorted parts -> ``key, row`` of the members with another within ``radius`` in another component, and of those others."""

    def ends(members: list[tuple]) -> list[int]:
        slices, own, of_block, met = BitSlices([m[1] & 0xFFFFFFFFFFFFFFFF for m in members]), {}, {}, 0
        for i, m in enumerate(members):
            own[m[2]] = own.get(m[2], 0) | 1 << i
            of_block[m[3]] = of_block.get(m[3], 0) | 1 << i
        for i, (_, fp, comp, block) in enumerate(members):
            among = ((1 << i) - 1) & ~own[comp]
            if len(of_block) > 1:
                among &= ~of_block[block]
            found = slices.near(fp & 0xFFFFFFFFFFFFFFFF, radius, among) if among else 0
            met |= found | (1 << i if found else 0)
        return [members[i][0] for i in _places(met).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def end_part() -> Iterator[pa.RecordBatch]:
            found = ends(members) if len(members) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "row"])

        for batch in batches:
            for key, part, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, part) != now:
                    yield from end_part()
                    now, members = (key, part), []
                members.append(tuple(member))
        yield from end_part()

    return run


def _places(bits: int) -> np.ndarray:
    """Places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))


#: Candidates of a member that are compared at once.
AT_ONCE = 256


def linked_sets(members: list[tuple], sets: list[np.ndarray], radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links ``a, b`` by which members ``row, fp, comp, block`` of different components hang
    together as by all pairs within ``radius`` whose sets are similar.

    Every such pair is compared, unless links found here or ``comp`` connect it already.
    Members of one block are left out if there are others.
    """
    slices, own, of_block = BitSlices([m[1] & 0xFFFFFFFFFFFFFFFF for m in members]), {}, {}
    comps = [m[2] for m in members]
    for i, m in enumerate(members):
        own[m[2]] = own.get(m[2], 0) | 1 << i
        of_block[m[3]] = of_block.get(m[3], 0) | 1 << i
    joined = {c: c for c in own}

    def find(c: int) -> int:
        while joined[c] != c:
            joined[c] = joined[joined[c]]
            c = joined[c]
        return c

    sizes = np.array([len(x) for x in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    number = np.split(shingle, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(shingle.max()) + 1, dtype=bool)
    for i, (row, fp, comp, block) in enumerate(members):
        among = ((1 << i) - 1) & ~own[find(comp)]
        if len(of_block) > 1:
            among &= ~of_block[block]
        found = slices.near(fp & 0xFFFFFFFFFFFFFFFF, radius, among) if among else 0
        if not found:
            continue
        mark[number[i]] = True
        while found:
            some = _places(found)[-AT_ONCE:]
            found &= (1 << int(some[0])) - 1
            both = np.add.reduceat(mark[np.concatenate([number[j] for j in some])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for j in some[both >= similarity * (sizes[i] + sizes[some] - both)].tolist():
                a, b = find(comp), find(comps[j])
                if a != b:
                    joined[b] = a
                    own[a] |= own.pop(b)
                    yield row, members[j][0]
            found &= ~own[find(comp)]
        mark[number[i]] = False


def _links_in_parts(radius: int, similarity: float):
    """Sorted parts, with the members' sets -> links ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, sets = None, [], []

        def end_part() -> Iterator[pa.RecordBatch]:
            links = list(linked_sets(members, sets, radius, similarity)) if len(members) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            flat, at = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
            for k, (key, part, *member) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:6]], strict=True)):
                if (key, part) != now:
                    yield from end_part()
                    now, members, sets = (key, part), [], []
                members.append(tuple(member))
                sets.append(flat[at[k] : at[k + 1]].copy())
        yield from end_part()

    return run


def _joined_by(roots: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """``node, root`` of components, stored, after further ``links`` ``a, b`` between their nodes or new ones.

    Only the new links, at most ``n_links``, are followed, between the components that they join.
    """
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    ends = _packed(_packed(links.join(one, "a", "left"), n_links).join(two, "b", "left"), n_links)
    between = stored(_packed(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct(), n_links))
    joined = stored(components(between))
    fresh = joined.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.union(fresh).join(few(moved), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def near_duplicates(df: DataFrame, *, row_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 20, tries: int = 2) -> DataFrame:
    """``row, root`` of every row that has a near-duplicate: word-shingle sets with a
    Jaccard similarity of at least ``similarity``, grouped over chains of links.

    Rows meet under MinHash keys of their shingles. Within a bucket, bit-sliced SimHash
    comparison finds candidates within ``radius`` bits (a similarity of 0.8 moves 10 bits
    of 64 on average, three deviations are 19), and each is verified on the shingle sets.
    A round verifies for each row and bucket the nearest earlier row that is not in its
    component yet. Where a round connects few, the next ones verify the ``tries`` nearest
    of each, until one connects few. So most links cost a few candidates a member and
    round. The rest is done by whole buckets: members with a candidate in another component
    get their shingle sets, and there every candidate is compared with every other that no
    link connects yet, so no candidate is left out, whatever ``tries`` is.
    ``row_col`` must be a stable, unique long.

    Null and empty texts have no near-duplicates; a text shorter than a shingle is one
    shingle. Equal texts are near-duplicates. Columns not named are not read. An empty
    table gives no rows.
    """
    src = pick(df, row=row_col, text_=text_col)
    sketched = table(src.mapInArrow(trimmed(_sketch(shingle, BANDS, BAND_ROWS)), SKETCH), "sketches")
    members = sketched.select("row", "fp", F.explode("keys").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = table(members.join(few(shared.select("key")), "key", "left_semi"), "buckets")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "set"])

    met = stored(members.select("row").distinct())
    shingles = table(src.join(few(met), "row", "left_semi").mapInArrow(trimmed(sets), "row long, set array<long>"), "shingle-sets")

    n_rows = met.count()

    def verified(pairs: DataFrame, most: int) -> DataFrame:
        one, two = shingles.select(F.col("row").alias("a"), F.col("set").alias("x")), shingles.select(F.col("row").alias("b"), F.col("set").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        found = _packed(pairs.join(one, "a"), most).join(two, "b").where(both >= similarity * (F.size("x") + F.size("y") - both))
        return stored(_packed(found.select("a", "b"), most))

    tested = df.sparkSession.createDataFrame([], "a long, b long")
    roots = df.sparkSession.createDataFrame([], "node long, root long")

    def unfinished(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the buckets whose members are not all in one, stored."""
        now = members.join(few(roots), members.row == roots.node, "left").select("key", "row", "fp", F.coalesce("root", "row").alias("comp"))
        buckets = now.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return now, stored(_packed(buckets.select("key", _blocks("n", SPLIT).alias("blocks")), BANDS * n_rows))

    n, more = 1, True
    now, open_ = unfinished(roots)
    while more:
        found = _deal(now, open_).mapInArrow(trimmed(_pairs_in_buckets(radius, n)), "a long, b long, key long, step long")
        most = BANDS * n_rows * n
        if n == 1:  # a member of a bucket in several parts has a nearest in each
            found = found.groupBy("a", "key").agg(F.min(F.struct("step", "b")).alias("x")).select("a", "x.b")
            found = _packed(found, most)
        pairs = stored(_packed(found.select("a", "b").distinct(), most).join(few(tested), ["a", "b"], "left_anti"))
        near = verified(pairs, most)
        tested = tested.union(pairs)
        n_near = near.count()
        if n_near:
            roots = stored(_packed(_joined_by(roots, near, n_near), n_rows))
            now, open_ = unfinished(roots)
        if n_near * WORTHWHILE < n_rows or not n_near:
            n, more = tries, n < tries

    # the candidates that no round has tried
    rest = _deal(now, open_).mapInArrow(trimmed(_with_candidates(radius)), "key long, row long").distinct()
    rest = stored(_packed(rest, BANDS * n_rows).join(now, ["key", "row"]).select("key", "row", "fp", "comp"))
    sized = rest.join(shingles.select("row", F.size("set").alias("n_set")), "row").groupBy("key").agg(F.count("*").alias("n"), F.sum("n_set").alias("n_set"))
    sized = stored(sized.select("key", F.greatest(_blocks("n", SPLIT), _blocks("n_set", SPLIT_SHINGLES)).alias("blocks")))
    dealt = _deal(rest.join(shingles, "row"), sized, "set")
    near = stored(dealt.mapInArrow(trimmed(_links_in_parts(radius, similarity)), "a long, b long").distinct())
    n_near = near.count()
    if n_near:
        roots = stored(_packed(_joined_by(roots, near, n_near), n_rows))
    return roots.withColumnRenamed("node", "row")
