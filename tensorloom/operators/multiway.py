"""Contraction of cyclic networks: all operands joined at once.

Joined two by two, a cycle such as ``ij,jk,ki->`` first makes all paths of two steps, which
may be far more than there are cycles. Here every operand is dealt out once, over a grid of
cells with a share of parts a label (the HyperCube exchange): a row goes to all cells that
agree with the parts of its own coordinates. In a cell, labels are bound one after another,
each by intersecting the sorted coordinates that the operands still allow, starting from
the shortest, so work follows the worst-case size of the output. Bindings are extended in
chunks of bounded size, and products are summed before they leave the cell.

Where at most four labels are joined, a part is a run of neighbouring coordinates and the rows
of each pair of parts are counted first, so that cells in which some operand has no rows are
not made: where coordinates go together, as keys that were given out in turn, few rows are
copied. Otherwise parts are by hash. Before they are copied, rows of one part are packed
(sorted, in as few bytes as their range needs), and operands are computed once and stored.

A coordinate that many rows have would put them into few cells, since hashing cannot
spread it. Frequent coordinates are known from sketches; each combination of labels with a
frequent coordinate gets a grid of its own, in which only the other labels are split.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.contract import Labelled
from tensorloom.operators.statistics import Statistics, measure
from tensorloom.plans.multiway import binding_order, patterns, range_shares, shares
from tensorloom.sources.scratch import scratch_dir
from tensorloom.tensor import Tensor, axis

#: Rows that a cell is expected to hold at most, and bindings that are extended at once.
CELL_ROWS, CHUNK = 1 << 20, 1 << 18
#: Joined labels up to which parts are runs of coordinates, and blocks of an operand that are counted for that.
RANGED, BLOCKS = 4, 1 << 12
#: Rows that are packed at once, and places of the tables by which a cell's keys are looked up (four bytes each).
PACKED, TABLES = 1 << 19, 1 << 25


def contract_cycle(parts: Sequence[Labelled], out: Sequence[Hashable], cells: int | None = None) -> Labelled:
    """Contract ``parts`` to the labels ``out`` with plus and times in one exchange an operand.

    Operands are measured first, one pass each. ``cells``: how many at least (by default
    the number of shuffle partitions).
    """
    names, spark = parts[0].names, parts[0].df.sparkSession
    count = lambda x: sum(x in p.labels for p in parts)
    parts = [p.summed([x for x in p.labels if x in out or count(x) > 1]) for p in parts]
    if any(p.dtype == "complex" for p in parts):
        parts = [p.promoted() for p in parts]
    parts = _stored(parts)
    stats = [_measured(p) for p in parts]
    joined = [x for x in dict.fromkeys(x for p in parts for x in p.labels) if count(x) > 1]
    order = binding_order([(p.labels, s.rows, dict(zip(p.labels, s.distinct, strict=True))) for p, s in zip(parts, stats, strict=True)], list(dict.fromkeys(x for p in parts for x in p.labels)))
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = _heavy(parts, stats, joined, cells)
    values = ["re", "im"] if parts[0].dtype == "complex" else ["v"]
    whole = all(kind in ("bigint", "int") for p in parts for n, kind in p.df.dtypes if n == "v") and len(values) == 1
    if len(joined) <= RANGED:
        routes, made = _ranged(parts, stats, joined, heavy, cells)
        rows = [p.df for p in parts]
    else:
        grids = _grids(parts, stats, joined, heavy, cells)
        routes, made = [None] * len(parts), sum(prod(n.values()) for _, n, _ in grids)
        rows = [p.df.withColumn("cell", F.explode(_cells(p, grids, heavy))) for p in parts]
    dealt = None
    for tag, (p, df, route) in enumerate(zip(parts, rows, routes, strict=True)):
        own = [x for x in order if x in p.labels]
        df = df.select(*([] if route else ["cell"]), *[F.col(names[x]).cast("long") for x in own], *[F.col(n).cast("long" if whole else "double").alias(n) for n in values])
        df = df.mapInArrow(_pack(route and (lambda cols, route=route, at=[own.index(x) for x in p.labels]: route([cols[k] for k in at])), len(own)), "cells array<long>, rows binary").select(F.explode("cells").alias("cell"), F.lit(tag).alias("tag"), "rows")
        dealt = df if dealt is None else dealt.unionByName(df)
    columns = [names[x] for x in out]
    kind = "long" if whole else "double"
    schema = ", ".join([f"{c} long" for c in columns] + [f"{v} {kind}" for v in values])
    run = _cell_join([[order.index(x) for x in order if x in p.labels] for p in parts], len(order), [order.index(x) for x in out], columns, values)
    found = dealt.repartition(max(cells, min(made, 4 * cells)), "cell").sortWithinPartitions("cell", "tag").mapInArrow(run, schema)
    result = Labelled(found, list(out), names, parts[0].dtype, None)
    if set(out) == set(order):
        return result
    sums = [F.sum(v).alias(v) for v in values]
    return Labelled(found.groupBy(*columns).agg(*sums) if columns else found.agg(*[F.coalesce(s, F.lit(0).cast(kind)).alias(v) for s, v in zip(sums, values, strict=True)]), list(out), names, parts[0].dtype, None if columns else 1.0)


def _stored(parts: Sequence[Labelled]) -> list[Labelled]:
    """The same, computed once and written, as they are read to be measured, to be counted and to be dealt
    out; as they are where driver and executors share no folder."""
    try:
        folder = scratch_dir(parts[0].df.sparkSession)
    except RuntimeError:
        return list(parts)
    out, seen = [], {}
    for p in parts:
        if id(p.df) not in seen:
            path = f"{folder}/operand-{uuid.uuid4().hex}"
            p.df.write.parquet(path)
            seen[id(p.df)] = p.df.sparkSession.read.schema(p.df.schema).parquet(path)
        out.append(Labelled(seen[id(p.df)], p.labels, p.names, p.dtype, p.cells, p.stats))
    return out


def _bounds(parts: Sequence[Labelled], stats: Sequence[Statistics], joined: Sequence[Hashable], fine: int) -> dict[Hashable, np.ndarray]:
    """By label the last coordinates of its ``fine`` runs but one, with about as many rows each of the operand that has most."""
    found: dict[Hashable, np.ndarray] = {}
    of = {x: max((k for k, p in enumerate(parts) if x in p.labels), key=lambda k: stats[k].rows) for x in joined}
    for k, p in enumerate(parts):
        own = [x for x in joined if of[x] == k]
        if own:
            row = p.df.agg(*[F.percentile_approx(p.names[x], [n / fine for n in range(1, fine)], 1000).alias(p.names[x]) for x in own]).first()
            found |= {x: np.sort(np.array(row[p.names[x]] or [], dtype=np.int64)) for x in own}
    return found


def _ranged(parts: Sequence[Labelled], stats: Sequence[Statistics], joined: Sequence[Hashable], heavy: dict, cells: int) -> tuple[list[Callable], int]:
    """For each operand a function of its columns that gives rows and the cells they go to, run by run, and the number of cells."""
    fine = 64
    while fine > 2 and max(fine ** sum(x in p.labels for x in joined) for p in parts) > BLOCKS:
        fine //= 2
    bounds = _bounds(parts, stats, joined, fine)
    counted = [_counted(p, [x for x in p.labels if x in bounds], bounds, heavy, fine) for p in parts]
    routes: list[list] = [[] for _ in parts]
    start, most = 0, max(max(1, sum(int(n.sum()) for n in by.values())) for by in counted)
    for h in patterns(joined, heavy):
        free = [x for x in joined if x not in h]
        own = [by.get(frozenset(x for x in h if x in p.labels)) for p, by in zip(parts, counted, strict=True)]
        if any(n is None for n in own):
            continue
        of_free = []
        for p, n in zip(parts, own, strict=True):
            mine = [x for x in p.labels if x in bounds]
            of_free.append(([x for x in mine if x in free], n.sum(axis=tuple(k for k, x in enumerate(mine) if x in h))))
        share, rows = range_shares(of_free, free, fine, max(1, round(cells * max(int(n.sum()) for n in own) / most)), CELL_ROWS)
        live = np.where(rows > 0, start + np.cumsum(rows.reshape(-1) > 0).reshape(rows.shape) - 1, -1)
        start += int((rows > 0).sum())
        for route, p in zip(routes, parts, strict=True):
            at = [free.index(x) for x in p.labels if x in free]
            grid = live.transpose([*at, *[k for k in range(len(free)) if k not in at]]).reshape(prod(share[x] for x in p.labels if x in free), -1)
            route.append((h, share, [c[c >= 0] for c in grid]))
    return [_route(list(p.labels), bounds, heavy, fine, own) for p, own in zip(parts, routes, strict=True)], start


def _flags(x: Hashable, column: np.ndarray, heavy: dict) -> np.ndarray:
    return np.isin(column, heavy.get(x) or [])


def _counted(p: Labelled, own: Sequence[Hashable], bounds: dict, heavy: dict, fine: int) -> dict[frozenset, np.ndarray]:
    """Rows by the run of each joined label, for each combination of labels with a heavy coordinate that has any."""
    base = fine ** len(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            at = np.zeros(b.num_rows, dtype=np.int64)
            for k, x in enumerate(own):
                at = at * fine + np.searchsorted(bounds[x], b.column(k).to_numpy())
            for k, x in enumerate(own):
                at += base * (_flags(x, b.column(k).to_numpy(), heavy).astype(np.int64) << k)
            for i, n in zip(*np.unique(at, return_counts=True), strict=True):
                total[int(i)] = total.get(int(i), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["at", "n"])

    found: dict[frozenset, np.ndarray] = {}
    for r in p.df.select(*[F.col(p.names[x]).cast("long") for x in own]).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most BLOCKS * 2 ** labels rows
        bits, at = divmod(r["at"], base)
        found.setdefault(frozenset(x for k, x in enumerate(own) if bits >> k & 1), np.zeros(base, dtype=np.int64))[at] = r["n"]
    return {h: n.reshape([fine] * len(own)) for h, n in found.items()}


def _route(labels: list[Hashable], bounds: dict, heavy: dict, fine: int, grids: list) -> Callable:
    """Of columns in the order of ``labels``: rows, and the cells that each of these runs of them goes to."""

    def route(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = {x: c for x, c in zip(labels, cols, strict=True) if x in bounds}
        run = {x: np.searchsorted(bounds[x], c) for x, c in own.items()}
        often = {x: _flags(x, c, heavy) for x, c in own.items() if heavy.get(x)}
        for h, share, cells in grids:
            here = np.ones(len(cols[0]), dtype=bool)
            for x, hit in often.items():
                here &= hit if x in h else ~hit
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            block = np.zeros(len(rows), dtype=np.int64)
            for x in own:
                if x in share:
                    block = block * share[x] + run[x][rows] * share[x] // fine
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
                to = cells[block[order[a]]]
                if len(to):
                    yield rows[order[a:z]], to

    return route


def _small(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Whole numbers as what is added to the smallest, in the narrowest type."""
    low = int(x.min())
    if int(x.max()) - low >= 1 << 32:
        return 0, x
    x = x - low
    return low, x.astype(np.min_scalar_type(int(x.max())))


def packed(cols: Sequence[np.ndarray], value: np.ndarray) -> bytes:
    """Rows in order, in few bytes; ``unpacked`` undoes it."""
    order = np.lexsort(cols[::-1]) if len(cols) else np.arange(len(value))
    cols, value = [c[order] for c in cols], value[order]
    steps = [np.diff(c, prepend=c[:1]) if k == 0 else c for k, c in enumerate(cols)]
    exact = value.dtype.kind == "i" or (value.dtype.kind == "f" and np.isfinite(value).all() and (np.abs(value) < 2**31).all() and (value == np.rint(value)).all() and not np.signbit(value[value == 0]).any())
    body = pickle.dumps(([int(c[0]) for c in cols[:1]], [_small(s) for s in steps], _small(value.astype(np.int64)) if exact else None, None if exact else value, value.dtype.str), protocol=5)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    first, steps, small, value, kind = pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    cols = [x.astype(np.int64) + low for low, x in steps]
    for start in first:
        cols[0] = np.cumsum(cols[0]) + start
    return cols, (small[1].astype(np.int64) + small[0]).astype(kind) if small else value


def _pack(route: Callable | None, n_labels: int):
    """Rows of labels and value (after ``cell`` where there is no ``route``) -> the cells they go to, and the rows packed."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        every = [t.column(k).to_numpy() for k in range(t.num_columns)]
        cells, every = (None, every) if route else (every[0], every[1:])
        cols, v = every[:n_labels], every[n_labels:]
        value = v[0] if len(v) == 1 else v[0] + 1j * v[1]
        if route:
            runs = route(cols)
        else:
            order = np.argsort(cells, kind="stable")
            edges = np.flatnonzero(np.diff(cells[order], prepend=-1))
            runs = ((order[a:z], cells[order[a]][None]) for a, z in zip(edges, [*edges[1:], len(order)], strict=True))
        for at, to in runs:
            yield pa.RecordBatch.from_arrays([pa.array([to.tolist()], pa.list_(pa.int64())), pa.array([packed([c[at] for c in cols], value[at])], pa.binary())], ["cells", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACKED:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _measured(p: Labelled) -> Statistics:
    if p.stats is not None:
        return p.stats
    return measure(Tensor(p.df.select(*[F.col(p.names[x]).alias(axis(k)) for k, x in enumerate(p.labels)], *p.values), [None] * len(p.labels), p.dtype))


def _heavy(parts: Sequence[Labelled], stats: Sequence[Statistics], joined: Sequence[Hashable], cells: int) -> dict[Hashable, list[int]]:
    """By label the coordinates that hold more of some operand's rows than a part of a label should."""
    found: dict[Hashable, set[int]] = {x: set() for x in joined}
    for p, s in zip(parts, stats, strict=True):
        for x, often in zip(p.labels, s.frequent, strict=True):
            if x in found:
                fair = max(s.rows / max(1, cells), CELL_ROWS / 64)
                found[x] |= {v for v, n in often.items() if n > fair}
    return {x: sorted(v) for x, v in found.items()}


def _grids(parts: Sequence[Labelled], stats: Sequence[Statistics], joined: Sequence[Hashable], heavy: dict, cells: int) -> list[tuple[frozenset, dict, int]]:
    """For each combination of heavy labels that has rows: the shares, and the number of its first cell."""
    some = patterns(joined, heavy)
    sizes: list[dict[frozenset, int]] = []
    for p, s in zip(parts, stats, strict=True):
        own = [x for x in p.labels if heavy.get(x)]
        if not own:
            sizes.append({frozenset(): s.rows})
            continue
        flags = [F.col(p.names[x]).isin(heavy[x]).alias(f"f{k}") for k, x in enumerate(own)]
        counted = p.df.select(*flags).groupBy(*[f"f{k}" for k in range(len(own))]).count().collect()  # at most 2 ** labels rows
        sizes.append({frozenset(x for x, hit in zip(own, r, strict=False) if hit): r["count"] for r in counted})
    out, start = [], 0
    for h in some:
        rows = [n.get(frozenset(x for x in h if x in p.labels), 0) for p, n in zip(parts, sizes, strict=True)]
        if all(rows):
            most = max(sum(n.values()) for n in sizes)
            own = max(1, round(cells * max(rows) / most))
            found = shares([(p.labels, n) for p, n in zip(parts, rows, strict=True)], joined, h, own, CELL_ROWS)
            out.append((h, found, start))
            start += prod(found.values())
    return out


def _shifted(base: Column, missing: Sequence[tuple[int, int]]):
    """``base`` moved to the i-th of all parts of the labels that are missing, given as (parts, step)."""

    def cell(i: Column) -> Column:
        total, below = base, 1
        for n, step in missing:
            total = total + F.floor(i / below).cast("long") % n * F.lit(step)
            below *= n
        return total.cast("long")

    return cell


def _cells(p: Labelled, grids: Sequence[tuple[frozenset, dict, int]], heavy: dict) -> Column:
    """All cells that a row of ``p`` goes to."""
    every = []
    for h, parts, start in grids:
        at, step, missing = F.lit(start).cast("long"), 1, []
        for k, (x, n) in enumerate(parts.items()):
            if x in p.labels:
                at = at + F.pmod(F.xxhash64(F.col(p.names[x]), F.lit(k)), F.lit(n)) * F.lit(step) if n > 1 else at
            elif n > 1:
                missing.append((n, step))
            step *= n
        copies = F.array(at)
        if missing:
            copies = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(prod(n for n, _ in missing) - 1).cast("long")), _shifted(at, missing))
        for x in p.labels:
            if heavy.get(x):
                hit = F.col(p.names[x]).isin(heavy[x])
                copies = F.when(hit if x in h else ~hit, copies)
        every.append(F.coalesce(copies, F.array().cast("array<long>")))
    return F.flatten(F.array(*every)) if every else F.array().cast("array<long>")


class Trie:
    """Rows of an operand in order: a level a label, the children of a node being a run of keys.

    ``tables``: by level, the places of all keys that there could be, -1 for those that are not, or None.
    """

    def __init__(self, codes: list[np.ndarray], sizes: list[int], values: np.ndarray) -> None:
        order = np.lexsort(codes[::-1])
        self.value, self.levels = values[order], []
        node, above = np.zeros(len(order), dtype=np.int64), 1
        for c, size in zip(codes, sizes, strict=True):
            c = c[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            parent, values_ = node[first], c[first]
            self.levels.append((values_, parent * size + values_, np.searchsorted(parent, np.arange(above + 1)), size))
            node, above = np.cumsum(new) - 1, len(first)
        self.tables: list[np.ndarray | None] = [None] * len(self.levels)

    def found(self, k: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys ``want`` are on a level, and which of them are there."""
        if self.tables[k] is not None:
            hit = self.tables[k][want]
            return hit, hit >= 0
        keys = self.levels[k][1]
        hit = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return hit, keys[hit] == want


def _with_tables(tries: list[Trie]) -> list[Trie]:
    """Tables for the smallest levels, of ``TABLES`` places in all."""
    room = TABLES
    for places, trie, k in sorted(((len(level[2]) - 1) * level[3], n, k) for n, trie in enumerate(tries) for k, level in enumerate(trie.levels)):
        room -= places
        if room < 0:
            break
        table = np.full(places, -1, dtype=np.int32)
        keys = tries[trie].levels[k][1]
        table[keys] = np.arange(len(keys), dtype=np.int32)
        tries[trie].tables[k] = table
    return tries


def _joined(tries: list[Trie], places: list[list[int]], n_labels: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Codes by label and products of all bindings, chunk by chunk."""

    def extend(t: int, bound: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        if t == n_labels:
            product = tries[0].value[nodes[0]]
            for trie, at in zip(tries[1:], nodes[1:], strict=True):
                product = product * trie.value[at]
            yield bound, product
            return
        those = [e for e, own in enumerate(places) if t in own]
        level = {e: tries[e].levels[places[e].index(t)] for e in those}
        counts = np.stack([level[e][2][nodes[e] + 1] - level[e][2][nodes[e]] for e in those])
        least = counts.min(axis=0)
        if least.sum() > CHUNK and len(least) > 1:
            cut = min(max(1, int(np.searchsorted(np.cumsum(least), CHUNK))), len(least) - 1)
            yield from extend(t, [b[:cut] for b in bound], [n[:cut] for n in nodes])
            yield from extend(t, [b[cut:] for b in bound], [n[cut:] for n in nodes])
            return
        chosen, found = counts.argmin(axis=0), []
        for place, e in enumerate(those):
            rows = np.flatnonzero((chosen == place) & (least > 0))
            if not len(rows):
                continue
            n = least[rows]
            row = np.repeat(rows, n)
            child = np.repeat(level[e][2][nodes[e][rows]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value = level[e][0][child]
            at = {e: child}
            for f in those:
                if f == e or not len(row):
                    continue
                hit, ok = tries[f].found(places[f].index(t), nodes[f][row] * level[f][3] + value)
                row, value = row[ok], value[ok]
                at = {g: x[ok] for g, x in at.items()} | {f: hit[ok]}
            if len(row):
                found.append((row, value, at))
        if found:
            row, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            after = [np.concatenate([f[2][e] for f in found]) if e in level else nodes[e][row] for e in range(len(tries))]
            yield from extend(t + 1, [b[row] for b in bound] + [value], after)

    yield from extend(0, [], [np.zeros(1, dtype=np.int64) for _ in tries])


def _cell_join(places: list[list[int]], n_labels: int, out: list[int], columns: list[str], values: list[str]):
    """Rows of whole cells, an operand after another -> sums by the labels ``out``, some of them more than once."""

    def cell(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if len({tag for tag, _ in rows}) < len(places):
            return
        own: list[list] = [[] for _ in places]
        for tag, data in rows:
            own[tag].append(unpacked(data))
        rows.clear()
        value = [np.concatenate([v for _, v in x]) for x in own]
        cols = [{k: np.concatenate([c[n] for c, _ in x]) for n, k in enumerate(at)} for x, at in zip(own, places, strict=True)]
        own.clear()
        kept: list[np.ndarray] = []
        codes: list[list[np.ndarray]] = [[] for _ in places]
        for k in range(n_labels):
            those = [e for e, own in enumerate(places) if k in own]
            kept.append(np.unique(np.concatenate([cols[e][k] for e in those])))
            for e in those:
                codes[e].append(np.searchsorted(kept[k], cols[e].pop(k)))
        tries = [Trie(c, [len(kept[k]) for k in own], v) for c, own, v in zip(codes, places, value, strict=True)]
        for bound, product in _joined(_with_tables(tries), places, n_labels):
            if out:
                order = np.lexsort([bound[k] for k in reversed(out)])
                new = np.ones(len(order), dtype=bool)
                new[1:] = False
                for k in out:
                    new[1:] |= bound[k][order][1:] != bound[k][order][:-1]
                first = np.flatnonzero(new)
                sums, keys = np.add.reduceat(product[order], first), [kept[k][bound[k][order][first]] for k in out]
            else:
                sums, keys = product.sum(keepdims=True), []
            parts = [sums] if len(values) == 1 else [sums.real, sums.imag]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *parts)], [*columns, *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                at = b.column(0)[k].as_py()
                if at != now and held:
                    yield from cell(held)
                    held = []
                now = at
                held.append((b.column(1)[k].as_py(), b.column(2)[k].as_py()))
        if held:
            yield from cell(held)

    return run
