"""Removal of repeated passages with suffix arrays sorted in two stages.

A repeated string of ``LENGTH`` bytes has the same least ``GRAM``-byte hash wherever it
stands. So texts are first cut into fragments by such anchors, each holding just the
strings its anchor stands for, and only fragments whose anchor occurs more than once
are dealt out, by anchor. Strings that repeat meet in one task there, and equal
fragments were counted and merged before.

Passages of more than ``WORDS`` words that stand in another text too are told apart by
the same sort, as a passage may be shorter than ``LENGTH`` bytes: units of 51 words,
which start at a word, have anchors as well, and where two neighbours in the order
agree over a whole unit, it is repeated.

A task joins fragments to blocks of bounded size and sorts each block's suffixes:
those smaller than their successor directly, all others by scanning the buckets of
first symbols in order and placing each entry's predecessor. Common prefixes of
neighbours then show which strings occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import few, numbered, pick, stored, table, trimmed

LENGTH, GRAM = 400, 64
#: A passage has more words than this.
WORDS = 50
#: Bytes of texts hashed at once, of fragments in a suffix array at most, and of small groups joined to one.
CHUNK, BLOCK, JOINED = 1 << 17, 1 << 20, 1 << 18
#: Fragments whose results are returned together.
READY = 2000
#: Occurrences of an anchor beyond which its fragments are dealt out by more of their bytes.
HOT = 20_000
#: Occurrences beyond which each string of a fragment is dealt out by itself, by its hash.
HOTTER = 1_000_000
#: Hashes with more than this part of all anchors are looked up in a broadcast table, of as many rows at most.
HEAVY = 10_000
#: Steps in which a fragment is cut finer: strings that start within so many bytes share a core.
CORES = (48, 6, 1)

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _doubled(symbols: np.ndarray, top: int) -> list[np.ndarray]:
    """Polynomial hashes of the 1, 2, 4, ... 2**top symbols from each place (garbage past the end)."""
    out = [_TABLE[symbols]]
    for k in range(top):
        h, n = out[-1], 1 << k
        ahead = np.concatenate((h[n:], np.zeros(min(n, len(h)), dtype=np.uint64)))[: len(h)]
        out.append(h * _power(n) + ahead)
    return out


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_units(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the units in the segments ``begins`` to ``ends`` of ``raw``.

    A unit starts at a word and has ``words + 1`` words, or ``length`` bytes if those are
    fewer. ``edges``: bit 1 if a segment's first byte cannot continue a word, bit 2 if its
    last byte cannot be continued.
    """
    solid = np.zeros(len(raw) + 2, dtype=bool)
    for_segment = np.zeros(len(raw) + 1, dtype=np.int64)
    for_segment[begins] += 1
    for_segment[ends] -= 1
    solid[1:-1] = ~_SPACE[raw] & (np.cumsum(for_segment)[:-1] > 0)
    head, tail = np.zeros(len(raw) + 1, dtype=bool), np.zeros(len(raw) + 1, dtype=bool)
    head[begins] = tail[ends] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | head[:-1]))
    stops = np.flatnonzero(solid[1:-1] & (~solid[2:] | tail[1:])) + 1
    if not len(starts):
        return starts, starts
    segment = np.searchsorted(ends, starts, side="right")
    last = np.minimum(np.arange(len(starts)) + words, len(starts) - 1)
    whole = (np.arange(len(starts)) + words < len(starts)) & (segment[last] == segment) & ((stops[last] < ends[segment]) | (edges[segment] & 2 > 0))
    span = np.where(whole, stops[last] - starts, length + 1)
    size = np.where(span <= length, span, np.where(ends[segment] - starts >= length, length, 0))
    ok = (size > 0) & ((starts > begins[segment]) | (edges[segment] & 1 > 0))
    return starts[ok], size[ok]


def _least_in(least: np.ndarray, starts: np.ndarray, width: int, others: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of ``least`` over ``width`` places from each of ``starts``, and over ``widths`` from ``others``."""
    one, two, now = starts[:0].astype(least.dtype), np.empty(len(others), dtype=least.dtype), least.copy()
    level, k = np.log2(widths).astype(np.int64), 0
    top = max(int(np.log2(width)), int(level.max(initial=0)))
    while True:
        if k == int(np.log2(width)):
            one = np.minimum(now[starts], now[starts + (width - (1 << k))])
        here = np.flatnonzero(level == k)
        two[here] = np.minimum(now[others[here]], now[others[here] + widths[here] - (1 << k)])
        if k == top:
            return one, two
        now[: -(1 << k)] = np.minimum(now[: -(1 << k)], now[1 << k :])
        k += 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """As the last of ``_doubled``, alone."""
    h, n = _TABLE[data], 1
    while n < gram:
        h[:-n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    return h


def anchors(data: np.ndarray, ends: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, before: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: grams that are least, rightmost of equals, in some ``length``-byte string
    or word unit within a text; ``ends``: where each text ends in ``data``. Returns their
    places, where the strings and units they stand for begin and end, their hashes, and
    the ``Starts`` of the strings alone. Each string and each unit has one anchor. Only
    those that start ``before`` a place are looked at, if one is given."""
    begins = np.concatenate(([0], ends[:-1]))
    left = np.repeat(ends, ends - begins) - np.arange(len(data))
    start = np.flatnonzero(left >= length)
    unit, size = word_units(data, begins, ends, edges, length, words)
    if before is not None:
        start, unit, size = start[start < before], unit[unit < before], size[unit < before]
    if not len(start) and not len(unit):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none
    h = _gram_hashes(data, gram)
    mixed = h ^ (h >> np.uint64(31))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bits, low = np.uint64(24), np.uint64((1 << 24) - 1)
    assert len(data) < 1 << 24
    least = (mixed >> bits << bits) | (low - np.arange(len(data), dtype=np.uint64))
    found = []
    for kind, first, n, minimum in zip((0, 1), (start, unit), (length, size), _least_in(least, start, length - gram + 1, unit, size - gram + 1), strict=True):
        if len(first):
            place = (low - (minimum & low)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            lo, hi = first[new], np.maximum.reduceat(first, new) + 1
            found.append((place[new], lo, np.maximum.reduceat(first + n, new), np.full(len(new), len(data)) if kind else lo, np.zeros(len(new), dtype=np.int64) if kind else hi))
    place, lo, end, one, stop = (np.concatenate([x[k] for x in found]) for k in range(5))
    order = np.argsort(place, kind="stable")
    place, lo, end, one, stop = (x[order] for x in (place, lo, end, one, stop))
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    place, lo, end = place[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(end, new)
    one, stop = np.minimum.reduceat(one, new), np.maximum.reduceat(stop, new)
    return place, lo, end, h[place], np.where(stop > 0, packed(one - lo, stop - one), 0)


def packed(first, n):
    """``Starts``: the first of the ``n`` places of a fragment whose strings it stands for, above four edge bits."""
    return (first << 4) | (n << 17)


def unpacked(edges: int) -> tuple[int, int]:
    """First and end of the starts."""
    first = edges >> 4 & 0x1FFF
    return first, first + (edges >> 17)


def suffix_array(symbols: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, each read for ``reach`` symbols (at most 511) only.

    ``symbols`` are 0 (a separator, reach 0) to 256, and the last is a separator.
    """
    n = len(symbols)
    # smaller than the successor: by the next different symbol
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    following = np.searchsorted(change, np.arange(n))
    direct = np.ones(n, dtype=bool)
    has = following < len(change)
    at = change[following[has]]
    direct[has] = symbols[at] < symbols[at + 1]

    small = np.flatnonzero(direct)
    ordered = small[np.argsort(_ranks(symbols, reach, small), kind="stable")]
    # bucket scans in the order of first symbols
    first = symbols[ordered]
    cut = np.searchsorted(first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        bucket = []
        fresh = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        while len(fresh):  # runs of c: each round places those one symbol earlier
            bucket.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[symbols[before] == c]
        bucket.append(ordered[cut[c] : cut[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        target = symbols[before]
        above = target > c
        before, target = before[above], target[above]
        if len(before):
            by = np.argsort(target, kind="stable")
            before, target = before[by], target[by]
            edges = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(before)], strict=True):
                waiting[target[a]].append(before[a:b])
    return np.concatenate(out)


def _ranks(symbols: np.ndarray, reach: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rank of each place's suffix, by sorting two keys of symbols at a time where earlier ones are equal.

    Suffixes equal over their whole reach are sorted once, as one. What all suffixes of
    a tie have in common is skipped, by hashes of 256, 128, ... 8 symbols.
    """
    pad = np.concatenate((symbols, np.zeros(528, dtype=symbols.dtype)))
    hashes = _doubled(pad, 8)
    value, at, left = reach[places].astype(np.uint64), places.copy(), reach[places]
    for k in range(8, -1, -1):
        take = (left >> k & 1).astype(bool)
        value[take] = value[take] * _power(1 << k) + hashes[k][at[take]]
        at = at + (take.astype(np.int64) << k)
    by_value = np.argsort(value)
    fresh = np.concatenate(([True], value[by_value[1:]] != value[by_value[:-1]]))
    same = np.empty(len(places), dtype=np.int64)
    same[by_value] = np.cumsum(fresh) - 1
    places = places[by_value[fresh]]
    # as many symbols in a key as fit, by their numbers among those that occur
    used = np.bincount(symbols, minlength=257) > 0
    used[0] = True
    code = (np.cumsum(used) - 1).astype(np.uint64)
    bits = max(1, int(code[-1]).bit_length())
    per = min(16, 64 // bits)
    packed_key, coded = np.zeros(len(symbols) + 513, dtype=np.uint64), code[pad]
    for k in range(per):
        packed_key <<= np.uint64(bits)
        packed_key |= coded[k : k + len(packed_key)]
    first = packed_key[places]
    order = np.argsort(first)
    key = first[order]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    rank = np.empty(len(places), dtype=np.int64)
    rank[order] = np.searchsorted(group, group)  # place of the group's first
    tied = order[np.bincount(rank, minlength=len(rank))[rank[order]] > 1]
    deep, rounds = np.full(len(tied), per), 0
    while len(tied):
        r = rank[tied]
        fresh = np.concatenate(([True], r[1:] != r[:-1]))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate((starts, [len(r)])))
        # most ties are of a few suffixes and end soon; large ones lose single members, and rarely have more in common
        for k in range(8, 2, -1) if rounds < 4 or rounds % 8 == 0 else ():
            h = hashes[k][np.minimum(places[tied] + deep, len(pad) - 1)]
            equal = np.minimum.reduceat(h, starts) == np.maximum.reduceat(h, starts)
            deep = deep + (np.repeat(equal, sizes).astype(np.int64) << k)
        at = places[tied] + deep
        key, more_key = packed_key[np.minimum(at, len(packed_key) - 1)], packed_key[np.minimum(at + per, len(packed_key) - 1)]
        differ = [np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts) for x in (key, more_key)]
        varied = np.flatnonzero(np.repeat(differ[0] | differ[1], sizes))
        by = varied[np.lexsort((more_key[varied], key[varied], r[varied]))]
        # ties stay where they were, so ``r`` and ``deep`` still hold
        tied[varied], key[varied], more_key[varied] = tied[by], key[by], more_key[by]
        new = fresh | np.concatenate(([True], (key[1:] != key[:-1]) | (more_key[1:] != more_key[:-1])))
        here = np.arange(len(r))
        rank[tied] = r + (np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(fresh, here, 0)))
        more = ~(new & np.concatenate((new[1:], [True]))) & (deep < 512)
        tied, deep, rounds = tied[more], deep[more] + 2 * per, rounds + 1
    return rank[same]


class Fragment(NamedTuple):
    """A distinct fragment: its bytes, where its anchor is, how often it occurs, ``edges``
    as in ``word_units`` with the ``Starts`` packed above them, and the text it is of, or
    None if it is of several. Strings that start elsewhere in it belong to other anchors,
    where they are counted; here they would meet themselves."""

    body: bytes
    lead: int
    times: int
    edges: int
    owner: int | None


#: For each start whether its ``length`` bytes are repeated, and the repeated units' starts and ends.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def all_of(f: Fragment, length: int, words: int) -> Found:
    """What is known of a fragment by itself: all of it is repeated if it occurs more than once."""
    mark = np.full(max(0, len(f.body) - length + 1), f.times > 1)
    none = np.zeros(0, dtype=np.int64)
    if f.owner is not None:
        return mark, none, none
    start, size = word_units(np.frombuffer(f.body, dtype=np.uint8), np.array([0]), np.array([len(f.body)]), np.array([f.edges]), length, words)
    return mark, start, start + size


def repeated(fragments: list[Fragment], length: int = LENGTH, words: int = WORDS) -> list[Found]:
    """For each fragment which starts have ``length`` bytes that occur at another place
    too, and which units occur in another text."""
    sizes = np.array([len(f.body) for f in fragments])
    marks = [np.full(max(0, len(f.body) - length + 1), f.times > 1) for f in fragments]
    n = int(sizes.sum()) + len(fragments)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    raw = np.frombuffer(b"\0".join([f.body for f in fragments]) + b"\0", dtype=np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[begins + sizes] = 0
    left = np.repeat(begins + sizes, sizes + 1) - np.arange(n)
    with np.errstate(over="ignore"):
        order = suffix_array(symbols, np.minimum(left, length))
    # common prefixes of neighbours, eight bytes at a time
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | np.concatenate((raw[k:], np.zeros(k, dtype=np.uint8)))[:n].astype(np.uint64)

    def agree(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the pairs whose first ``size`` bytes (eight at least) are equal."""
        pair = np.arange(len(a))
        for k in range(0, length, 8):
            step = np.minimum(k, size[pair] - 8)
            pair = pair[eight[a[pair] + step] == eight[b[pair] + step]]
        return pair

    own = np.zeros(n + 1, dtype=np.int64)
    for at, f in zip(begins.tolist(), fragments, strict=True):
        first, stop = unpacked(f.edges)
        own[at + first] += 1
        own[at + stop] -= 1
    mine = order[np.cumsum(own)[order] > 0]
    a, b = mine[:-1], mine[1:]
    same = agree(a, b, np.full(len(a), length))
    found = np.zeros(n, dtype=bool)
    found[a[same]] = found[b[same]] = True
    for k, mark in enumerate(marks):
        mark |= found[begins[k] : begins[k] + len(mark)]

    start, size = word_units(raw, begins, begins + sizes, np.array([f.edges for f in fragments]), length, words)
    need = np.zeros(n, dtype=np.int64)
    need[start] = size
    unit = order[need[order] > 0]
    owner = np.array([0 if f.owner is None else f.owner for f in fragments], dtype=np.int64)
    several = np.array([f.owner is None for f in fragments])
    hit = np.zeros(n, dtype=bool)
    if len(unit):
        a, b = unit[:-1], unit[1:]
        level = np.flatnonzero(need[a] == need[b])
        linked = np.zeros(len(unit), dtype=bool)
        linked[1 + level[agree(a[level], b[level], need[a[level]])]] = True
        first = np.flatnonzero(~linked)
        of = np.searchsorted(begins, unit, side="right") - 1
        shared = (np.minimum.reduceat(owner[of], first) != np.maximum.reduceat(owner[of], first)) | np.maximum.reduceat(several[of], first)
        hit[unit] = shared[np.cumsum(~linked) - 1]
    out = []
    for k, mark in enumerate(marks):
        at = np.flatnonzero(hit[begins[k] : begins[k] + sizes[k]])
        out.append((mark, at, at + need[begins[k] + at]))
    return out


def cores(fragment: bytes, lead: int, step: int, starts: tuple[int, int], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, bytes, bytes]]:
    """Parts of a fragment as (offset, part, core).

    The strings that start at ``step`` consecutive places of ``starts``, counted from the
    anchor at ``lead``, make up a part; all of them contain its core.
    """
    shift = length - gram - lead  # 0 for a fragment that no text end has shortened
    first, stop = starts
    if stop <= first:  # it holds units only
        return
    for k in range((first + shift) // step, (stop - 1 + shift) // step + 1):
        begin, end = k * step - shift, k * step + step - 1 - shift
        at = max(first, begin)
        yield at, fragment[at : min(end, stop - 1) + length], k.to_bytes(4, "little", signed=True) + fragment[max(0, end) : begin + length]


def repeated_in_group(fragments: list[Fragment], length: int = LENGTH, gram: int = GRAM, words: int = WORDS, block: int = BLOCK, steps: tuple[int, ...] = CORES) -> list[Found]:
    """As ``repeated``, for fragments of one anchor.

    A group larger than a block is first dealt into groups of one core each, whose
    equal parts are merged; after the last step a part is one string. Units are then
    looked up by their bytes.
    """
    if len(fragments) == 1:  # its strings have their anchor at different distances, so no two are equal
        return [all_of(fragments[0], length, words)]
    if sum(len(f.body) for f in fragments) <= block:
        return repeated(fragments, length, words)
    out = [all_of(f, length, words) for f in fragments]
    owners: dict[bytes, set] = {}
    units = []
    for f in fragments:
        start, size = word_units(np.frombuffer(f.body, dtype=np.uint8), np.array([0]), np.array([len(f.body)]), np.array([f.edges]), length, words)
        units.append([(a, a + n, xxhash.xxh3_128_digest(f.body[a : a + n])) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        for _, _, key in units[-1]:
            owners.setdefault(key, set()).add(f.owner)
    for k, own in enumerate(units):
        some = [(a, b) for a, b, key in own if len(owners[key]) > 1 or None in owners[key]]
        out[k] = (out[k][0], np.array([a for a, _ in some], dtype=np.int64), np.array([b for _, b in some], dtype=np.int64))
    _mark_strings(fragments, [f[0] for f in out], length, gram, block, steps)
    return out


def _mark_strings(fragments: list[Fragment], marks: list[np.ndarray], length: int, gram: int, block: int, steps: tuple[int, ...]) -> None:
    """Mark the repeated strings of fragments of one anchor, dealt into groups of one core each."""
    groups: dict[bytes, dict[tuple[bytes, int], list[tuple[int, int]]]] = {}
    for k, f in enumerate(fragments):
        for at, part, core in cores(f.body, f.lead, steps[0], unpacked(f.edges), length, gram):
            groups.setdefault(xxhash.xxh3_128_digest(core), {}).setdefault((part, f.lead - at), []).append((k, at))
    for same in groups.values():
        parts = [Fragment(p, lead, 2 if len(v) > 1 or fragments[v[0][0]].times > 1 else 1, packed(0, len(p) - length + 1), 0) for (p, lead), v in same.items()]
        found = [np.full(len(p.body) - length + 1, p.times > 1) for p in parts]
        if len(parts) > 1 and sum(len(p.body) for p in parts) > block and len(steps) > 1:
            _mark_strings(parts, found, length, gram, block, steps[1:])
        elif len(parts) > 1:
            found = [x[0] for x in repeated(parts, length, 1 << 30)]
        for where, mark in zip(same.values(), found, strict=True):
            for k, at in where:
                marks[k][at : at + len(mark)] |= mark


def _runs(mark: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of marked starts as byte spans."""
    if not mark.any():
        return []
    if mark.all():
        return [(0, len(mark) - 1 + length)]
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return [(int(a), int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


ANCHORS = "row long, lo array<int>, end array<int>, lead array<int>, hashes array<long>, starts array<int>"
#: Kinds of rows: a fragment with its two edge bits, a single string, a single unit.
STRING, UNIT = 4, 8


def _edges(body: bytes, lo: int, end: int) -> int:
    return int(lo == 0 or _SPACE[body[lo - 1]]) | 2 * int(end == len(body) or _SPACE[body[end]] or _SPACE[body[end - 1]])


def _find_anchors(length: int, gram: int, words: int):
    """Rows ``row, text`` -> ``row`` and arrays of start, end, anchor from there, and hash; texts without an anchor give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[int], texts: list[bytes], edges: list[int], move: int = 0, before: int | None = None) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore"):
                place, lo, end, h, starts = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, np.array(edges), length, gram, words, before)
            owner = np.searchsorted(ends, place, side="right")
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            base = (ends - sizes)[owner] - move
            some = [k for k in range(len(texts)) if cut[k + 1] > cut[k]]
            arrays = [x.astype(np.int32) for x in (lo - base, end - base, place - lo)] + [h.view(np.int64), starts.astype(np.int32)]
            columns = [pa.array([x[cut[k] : cut[k + 1]] for k in some], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in arrays]
            return pa.RecordBatch.from_arrays([pa.array([rows[k] for k in some], pa.int64()), *columns], [x.split()[0] for x in ANCHORS.split(", ")])

        for batch in batches:
            rows, texts, held = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_py().encode()
                if len(body) <= CHUNK:
                    rows.append(row)
                    texts.append(body)
                    held += len(body)
                else:
                    for at in range(0, len(body), CHUNK):  # a very long text in pieces that overlap by one string
                        end = min(len(body), at + CHUNK + length - 1)
                        yield found([row], [body[at:end]], [_edges(body, at, end)], at, CHUNK if end < len(body) else None)
                if held > CHUNK:
                    yield found(rows, texts, [3] * len(texts))
                    rows, texts, held = [], [], 0
            if texts:
                yield found(rows, texts, [3] * len(texts))

    return run


FRAGMENTS = "group binary, digest binary, lead int, body binary, edges int, row long, starts array<int>"


def _cut_fragments(length: int, gram: int, words: int):
    """Rows ``row, text, found`` (array of anchors) -> fragments, each once a text."""
    names = [x.split()[0] for x in FRAGMENTS.split(", ")]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def fragments_of(body: bytes, x: dict) -> Iterator[tuple[tuple, int]]:
        """(group, body, lead, edges) and the place of each row of an anchor."""
        at, lead, h = x["lo"], x["lead"], x["hash"].to_bytes(8, "little", signed=True)
        fragment, edges = body[at : x["end"]], _edges(body, at, x["end"]) | x["starts"]
        if x["n"] <= HOT:
            yield (h, fragment, lead, edges), at
            return
        if x["n"] <= HOTTER:
            for more, part, core in cores(fragment, lead, CORES[0], unpacked(edges), length, gram):
                yield (xxhash.xxh3_128_digest(h + core), part, lead - more, packed(0, len(part) - length + 1)), at + more
        else:
            for k in range(*unpacked(edges)):
                yield (xxhash.xxh3_128_digest(fragment[k : k + length]), b"", length, STRING), at + k
        start, size = word_units(np.frombuffer(fragment, dtype=np.uint8), np.array([0]), np.array([len(fragment)]), np.array([edges]), length, words)
        ours = [(k, k + n) for k, n in zip(start.tolist(), size.tolist(), strict=True) if k <= lead and lead + gram <= k + n]
        if x["n"] > HOTTER:
            for a, b in ours:
                yield (xxhash.xxh3_128_digest(b"unit " + fragment[a:b]), b"", b - a, UNIT), at + a
            return
        # units by steps of their start; all of a step reach from its end over the anchor
        for step, some in groupby(ours, lambda u: (u[0] - lead) // CORES[0]):
            part = list(some)
            a, b = part[0][0], max(e for _, e in part)
            core = fragment[lead + min(0, step * CORES[0] + CORES[0] - 1) : lead + gram]
            yield (xxhash.xxh3_128_digest(b"unit %d " % step + h + core), fragment[a:b], lead - a, 3), at + a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row, text, found in zip(*[batch.column(k) for k in range(3)], strict=True):
                body, own = text.as_py().encode(), {}
                for x in found.as_py():
                    for key, at in fragments_of(body, x):
                        own.setdefault(key, set()).add(at)
                for (group, fragment, lead, edges), starts in own.items():
                    digest = xxhash.xxh3_128_digest(fragment + edges.to_bytes(4, "little")) if fragment else group
                    out.append((group, digest, lead, fragment, edges, row.as_py(), sorted(starts)))
                    held += len(fragment) + 100
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [], 0
        yield rows(out)

    return run


MARKED = "group binary, digest binary, lead int, spans array<struct<lo:long,hi:long,passage:boolean>>"


def _mark(length: int, gram: int, words: int):
    """Distinct fragments ``group, digest, lead, body, edges, times, owner`` sorted by group
    -> ``group, digest, lead, spans``.

    A group has at most ``HOTTER`` fragments, as the anchors beyond are dealt out by string.
    """
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("passage", pa.bool_())]))

    def rows(some: list[tuple], found: list[Found]) -> pa.RecordBatch:
        spans = [
            [{"lo": a, "hi": b, "passage": False} for a, b in _runs(mark, length)] + [{"lo": a, "hi": b, "passage": True} for a, b in _joined(zip(start.tolist(), end.tolist(), strict=True))]
            for mark, start, end in found
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.int32()), pa.array(spans, kind)], ["group", "digest", "lead", "spans"])

    def single(row: tuple) -> Found:
        none = np.zeros(0, dtype=np.int64)
        if row[4] & STRING:
            return np.full(1, row[5] > 1), none, none
        return np.zeros(0, dtype=bool), np.zeros(int(row[6] is None), dtype=np.int64), np.full(int(row[6] is None), row[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        group: list[tuple] = []
        singles: list[tuple] = []
        ready: list[tuple[tuple, Found]] = []
        held = size = 0
        fragments = lambda some: [Fragment(r[3], r[2], r[5], r[4], r[6]) for r in some]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if block:
                yield rows(block, repeated(fragments(block), length, words))
            block, held = [], 0

        def send(least: int = 1) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if len(ready) >= least:
                yield rows([r for r, _ in ready], [f for _, f in ready])
                ready = []

        def end_group() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, group, size
            if all(r[5] > 1 and r[6] is None for r in group):  # of each fragment all is repeated
                ready.extend(zip(group, [all_of(f, length, words) for f in fragments(group)], strict=True))
            elif size > BLOCK or len(group) == 1:  # large groups are split until they fit
                ready.extend(zip(group, repeated_in_group(fragments(group), length, gram, words), strict=True))
            else:
                block.extend(group)
                held += size
                if held > JOINED:
                    yield from flush()
            yield from send(READY)
            group, size = [], 0

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[4] & (STRING | UNIT):
                    singles.append(row)
                    continue
                if group and row[0] != group[0][0]:
                    yield from end_group()
                group.append(row)
                size += len(row[3])
            if singles:
                yield rows(singles, [single(r) for r in singles])
                singles = []
        yield from end_group()
        yield from flush()
        yield from send()

    return run


def _joined(spans) -> list[list[int]]:
    """Spans as the fewest that cover the same."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif b > a:
            merged.append([a, b])
    return merged


#: End of the span that stands for a text with copies.
ALL = 1 << 62


def _remove(length: int, words: int, with_bytes: bool):
    """Rows ``doc_id, text, spans`` -> the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "kept"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                body, spans = text.as_py().encode(), found.as_py() or ()
                merged, passages = ([(s["lo"], s["hi"]) for s in spans if s["passage"] == p] for p in (False, True))
                if (0, ALL) in merged:
                    merged = [(0, len(body))] if len(body) >= length else []
                    passages = [(0, len(body))] if merged or len(body.split()) > words else []
                merged, passages = _joined(merged), _joined(passages)
                kept, at = [], 0
                for a, b in merged:
                    kept.append(body[at:a])
                    at = b
                left = b"".join([*kept, body[at:]])
                row = (len(body), len(body) - len(left), len(merged), hashlib.sha256(left).hexdigest(), len(passages), sum(len(body[a:b].split()) for a, b in passages), left)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 6 + with_bytes]], names[: 7 + with_bytes])

    return run


def _counted(flat: DataFrame) -> DataFrame:
    """Anchors whose hash occurs more than once, with how often.

    A hash with more than 1 / ``HEAVY`` of all anchors would gather in one task of a join;
    there are at most ``HEAVY`` such hashes, and those are looked up in a broadcast table.
    """
    often = stored(flat.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    floor = (often.agg(F.sum("n")).first()[0] or 0) / HEAVY
    heavy = F.broadcast(often.where(F.col("n") > max(HOT, floor)))
    rest = flat.join(heavy, "hash", "left_anti").join(often.where(F.col("n") <= max(HOT, floor)), "hash")
    return flat.join(heavy, "hash").unionByName(rest)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS, with_bytes: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_passages, n_passage_words`` and, ``with_bytes``, what is ``kept`` (bytes, as a cut may
    fall inside a character).

    Every byte is removed that lies in a string of ``length`` bytes which also starts at
    another place of the input, in the same text or in another; strings do not reach
    over the ends of texts. ``n_passages``: maximal stretches covered by units that also
    stand in another row; a unit starts at a word and has more than ``words`` words (one
    more), or ``length`` bytes where those are fewer. ``n_passage_words``: the words in
    them. Passages are told, not removed.

    Null text counts as empty; texts shorter than ``length`` bytes are kept. Texts that
    occur in several rows are removed from all of them if they are long enough, and are
    one passage if they have a unit's size. Null and repeated ids do no harm, and an id
    may have any type: rows are numbered, and copies are told by 128 bits of their hash.
    An empty table gives no rows; columns not named are not read.
    """
    least = min(length, 2 * words + 1)
    if least < gram or length > 511:
        raise ValueError("a string and a unit must have room for a gram, and a string has 511 bytes at most")
    src = pick(df, doc_id=id_col, text_=text_col)
    src = numbered(src.select("doc_id", F.coalesce(F.col("text_").cast("string"), F.lit("")).alias("text")))
    # one row stands for all with its text
    keys = stored(src.where(F.octet_length("text") >= least).select("row", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")))
    several = stored(keys.groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("k1", "k2", "first"))
    copied = stored(keys.join(few(several), ["k1", "k2"]).select("row", "first"))
    once = src.where(F.octet_length("text") >= least).join(few(copied.where("row <> first").select("row")), "row", "left_anti").select("row", "text")
    found = table(once.mapInArrow(trimmed(_find_anchors(length, gram, words)), ANCHORS), "anchors")
    flat = found.select("row", F.explode(F.arrays_zip("lo", "end", "lead", F.col("hashes").alias("hash"), "starts")).alias("x")).select("row", "x.*")
    places = _counted(flat).groupBy("row").agg(F.collect_list(F.struct("lo", "end", "lead", "hash", "n", "starts")).alias("found"))
    cut = once.join(places, "row").select("row", "text", "found")
    fragments = table(cut.mapInArrow(trimmed(_cut_fragments(length, gram, words)), FRAGMENTS), "fragments")
    distinct = fragments.groupBy("group", "digest", "lead").agg(F.first("body").alias("body"), F.first("edges").alias("edges"), F.sum(F.size("starts")).alias("times"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    distinct = distinct.select("group", "digest", "lead", "body", "edges", "times", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("owner"))
    marked = distinct.repartition("group").sortWithinPartitions("group").mapInArrow(trimmed(_mark(length, gram, words)), MARKED).where(F.size("spans") > 0)
    spans = fragments.select("group", "digest", "lead", "row", "starts").join(marked, ["group", "digest", "lead"])
    spans = spans.select("row", F.explode("starts").alias("at"), "spans").select("row", F.explode(F.transform("spans", lambda s: F.struct((s["lo"] + F.col("at")).alias("lo"), (s["hi"] + F.col("at")).alias("hi"), s["passage"].alias("passage")))).alias("s"))
    single = spans.groupBy("row").agg(F.collect_set("s").alias("spans")).join(few(copied.select("row")), "row", "left_anti")
    whole = copied.select("row", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(ALL).alias("hi"), F.lit(False).alias("passage"))).alias("spans"))
    rows = src.join(single.unionByName(whole), "row", "left")
    shape = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + ", kept binary" * with_bytes
    return rows.select("doc_id", "text", "spans").mapInArrow(trimmed(_remove(length, words, with_bytes)), shape)
