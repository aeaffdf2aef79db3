"""Exact deduplication with a log-structured merge index.

Map tasks collect their rows by digest in a memtable and flush it as a sorted run:
one entry per digest with the best row and the members. Runs are stored, and dealt
out by digest to index partitions; there a memtable is flushed as sorted digest runs with a Bloom filter
each, new digests are looked up only in runs whose filter may hold them, and
compaction merges runs and keeps the smallest identifiers. Digests that occur in
several runs are hits, and the bytes of their entries, read again from the source, are
compared before rows count as equal.

However large a group of copies is, it is at most one entry a map memtable; what
is kept of it is one identifier and counts.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tensorloom.llm.common import few, numbered, pick, stored, table, trimmed

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text, and members of one entry, after which a map memtable is flushed.
MEMTABLE_BYTES, MEMBERS = 16 << 20, 20_000
#: Entries an index partition takes at most, about, and with them less than 200 MB.
INDEXED = 1_000_000


def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


class BloomFilter:
    """Ten bits a key; the key's own bytes serve as hashes."""

    def __init__(self, keys: Sequence[bytes]) -> None:
        self.bits = max(64, 10 * len(keys))
        self.data = np.zeros(self.bits // 8 + 1, dtype=np.uint8)
        for k in range(0, len(keys), 50_000):
            for at in self._places([keys[i] for i in range(k, min(k + 50_000, len(keys)))]).T:
                np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, keys: list[bytes]) -> np.ndarray:
        packed = b"".join((k * (16 // max(1, len(k)) + 1))[:16] for k in keys)
        two = np.frombuffer(packed, dtype="<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            return np.stack([(two[:, 0] + np.uint64(i) * (two[:, 1] | np.uint64(1))) % np.uint64(self.bits) for i in range(5)], axis=1).astype(np.int64)

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        at = self._places(keys)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Run:
    """A sorted run: keys end to end in one block of bytes, entries as six longs each."""

    def __init__(self, entries: Iterable[tuple[bytes, tuple]]) -> None:
        keys, ends, numbers = bytearray(), array("q", [0]), array("q")
        for key, ((rank, no_id, doc_id, row), size, n) in entries:
            keys += key
            ends.append(len(keys))
            numbers.extend((rank, no_id, doc_id, row, size, n))
        self.keys, self.ends, self.numbers = bytes(keys), ends, numbers
        self.live = bytearray(b"\1") * len(self)
        self.bloom = BloomFilter(self)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, at: int) -> bytes:
        return self.keys[self.ends[at] : self.ends[at + 1]]

    def entry(self, at: int) -> tuple:
        rank, no_id, doc_id, row, size, n = self.numbers[6 * at : 6 * at + 6]
        return (rank, bool(no_id), doc_id, row), size, n

    def entries(self) -> Iterator[tuple[bytes, tuple]]:
        return ((self[k], self.entry(k)) for k in range(len(self)) if self.live[k])


class LsmIndex:
    """key -> (smallest identifier, size, entries), in a memtable and sorted runs.

    Only the memtable holds Python objects, at most ``memtable`` of them; a run takes
    some 100 bytes an entry with its filter.
    """

    def __init__(self, memtable: int = 100_000, fanout: int = 4) -> None:
        self.limit, self.fanout = memtable, fanout
        self.memory: dict[bytes, tuple] = {}
        self.runs: list[Run] = []

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        return min(a[0], b[0]), a[1] + b[1], a[2] + b[2]

    def put(self, key: bytes, value: tuple) -> None:
        old = self.memory.get(key)
        self.memory[key] = value if old is None else self.merged(old, value)
        if len(self.memory) >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.memory:
            return
        keys = sorted(self.memory)
        self._take_hits(keys)
        self.runs.append(Run((k, self.memory[k]) for k in keys))
        self.memory = {}
        if len(self.runs) > self.fanout:
            self.compact()

    def _take_hits(self, keys: list[bytes]) -> None:
        """Move what older runs have of the memtable's keys into the memtable."""
        for old in self.runs:
            for k in np.flatnonzero(old.bloom.maybe(keys)).tolist():
                at = bisect_left(old, keys[k])
                if at < len(old) and old[at] == keys[k] and old.live[at]:
                    self.memory[keys[k]] = self.merged(self.memory[keys[k]], old.entry(at))
                    old.live[at] = 0  # superseded by the newer run

    def compact(self) -> None:
        """One sorted run of all; of equal keys one entry is live."""
        if len(self.runs) > 1:
            self.runs = [Run(self._live())]

    def _live(self) -> Iterator[tuple[bytes, tuple]]:
        return merge(*[run.entries() for run in self.runs], key=lambda x: x[0])

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All entries by key; the last compaction is read as it is merged."""
        self.flush()
        return self._live()


RUNS = "digest binary, entry long, rank long, id long, row long, size long, members array<struct<id:long,row:long>>"


def _flush_runs(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))
        names = [x.split()[0] for x in RUNS.split(", ")[:6]] + ["members"]
        memory: dict[tuple[bytes, bytes], list] = {}  # the bytes in the key are compared on each hit
        held, entry = 0, TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal held, entry, memory
            rows = sorted((d, b, v) for (d, b), v in memory.items())
            first = entry
            entry += len(rows)
            memory, held = {}, 0
            best = [min(v) for _, _, v in rows]
            columns = [
                pa.array([d for d, _, _ in rows], pa.binary()), pa.array(range(first, entry), pa.int64()),
                pa.array([x[0] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.int64()), pa.array([x[3] for x in best], pa.int64()),
                pa.array([len(v) for _, _, v in rows], pa.int64()),
                pa.array([[{"id": x[2], "row": x[3]} for x in v] for _, _, v in rows], kind),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                body = text.encode().translate(None, SPACES)
                group = memory.setdefault((digest(body), body), [])
                # most code points first, then the smallest id (null last), then the first row
                group.append((-len(text), doc_id is None, doc_id, row) if doc_id is not None else (-len(text), True, None, row))
                held += 64 + (len(body) if len(group) == 1 else 0)
                if held > MEMTABLE_BYTES or len(group) >= MEMBERS:
                    yield flush()
        if memory:
            yield flush()

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = LsmIndex()
    for b in batches:
        for key, variant, rank, doc_id, row, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
            index.put(key + variant.to_bytes(4, "big"), ((rank, doc_id is None, doc_id or 0, row), size, 1))
    names = ["digest", "variant", "keep_id", "keep_row", "group_size", "entries"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    found = index.items()
    while part := list(islice(found, 20_000)):
        columns = zip(*[(k[:-4], int.from_bytes(k[-4:], "big"), None if v[0][1] else v[0][2], v[0][3], v[1], v[2]) for k, v in part], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by digest -> those whose bytes differ from the first of their digest, numbered by text."""
    last, texts = None, []
    for b in batches:
        entries, variants = [], []
        for digest, entry, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            body = text.as_py().encode().translate(None, SPACES)
            if digest != last:
                last, texts = digest, [body]
            elif body != texts[0]:
                if body not in texts:
                    texts.append(body)
                entries.append(entry)
                variants.append(texts.index(body))
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(variants, pa.int64())], ["entry", "variant"])


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest, row``.

    Texts are equal when identical without ASCII white space. Of equal ones the row
    with the most code points stays, then the smallest id, null ids last, then the
    first row. ``row`` numbers the input rows, or is the unique long in ``row_col``; ``keep_id`` may be null only if every
    longest copy's id is null.

    Null text counts as empty; all empty texts are one group. Repeated rows are
    copies of each other, of which one is kept. Texts of any length are compared
    byte by byte, and ``digest`` need not be free of collisions. An empty table
    gives no rows; columns not named are not read.
    """
    src = pick(df, doc_id=id_col, text_=text_col, **({"row_": row_col} if row_col else {}))
    src = src if row_col else numbered(src, "row_")
    src = src.select(F.col("row_").alias("row"), F.col("doc_id").cast("long"), F.col("text_").cast("string"))
    runs = table(src.mapInArrow(trimmed(_flush_runs(digest)), RUNS), "digest-runs")
    light = runs.select("digest", F.lit(0).cast("long").alias("variant"), "rank", "id", "row", "size")
    shape = "digest binary, variant long, keep_id long, keep_row long, group_size long, entries long"
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // INDEXED))
    first = stored(light.repartition(parts, "digest").mapInArrow(trimmed(_index), shape))
    hits = stored(runs.select("digest", "entry", "row").join(first.where("entries > 1").select("digest"), "digest", "left_semi"))
    bodies = src.select("row", "text_").join(few(hits), "row").select("digest", "entry", F.coalesce("text_", F.lit("")).alias("text"))
    checked = bodies.repartition("digest").sortWithinPartitions("digest", "entry")
    differing = stored(checked.mapInArrow(_verify, "entry long, variant long"))
    entries = runs.select("digest", "entry", "rank", "id", "row", "size", "members")
    if differing.isEmpty():
        entries, groups = entries.withColumn("variant", F.lit(0).cast("long")), first
    else:  # a digest shared by different texts: its entries are grouped again by text
        entries = entries.join(differing, "entry", "left").withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))
        groups = entries.select("digest", "variant", "rank", "id", "row", "size").repartition(parts, "digest").mapInArrow(_index, shape)
    pairs = entries.select("digest", "variant", "members").join(groups.drop("entries"), ["digest", "variant"])
    each = pairs.select("digest", "keep_id", "keep_row", "group_size", F.explode("members").alias("m"))
    return each.select(F.col("m.id").alias("doc_id"), "keep_id", "group_size", (F.col("m.row") == F.col("keep_row")).alias("kept"), "digest", F.col("m.row").alias("row"))


#: DuckDB: the same by windows over the digest.
ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
