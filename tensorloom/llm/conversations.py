"""Repair of conversations by the cheapest edits, on a bidirectional DAG of tight arcs.

A conversation's rows in order are the columns of a DAG whose nodes are states of
``(s?(ua)+)?``: nothing yet, after s, after u, after a. Keep, rerole and delete lead to
the next column, insert stays in it. The minimum costs forward from the start and
backward from the end tell all arcs on a cheapest path: those where both and the arc's
own cost make up the optimum. A set of frontier nodes then goes along tight arcs by the
least letter that any of them offers, which spells the least of the cheapest edits.

A conversation of any length is worked on in blocks. What a block does to costs is a
matrix (minimum, plus), what it does to the frontier a map of sets, so long
conversations need a row a block, read in order, to tell every block what lies before and
after it. Texts take no part until the edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import blocks_of, few, in_order, numbered, pick, stored

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
NEVER = 1 << 60
#: Rows of a block.
BLOCK = 4096
#: What an edit costs; a truncated row that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, DUPLICATE, CUT = 1, 2, 3
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: Where a turn of user or assistant may come: (from, to).
TURNS = ((START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U), (AFTER_U, AFTER_A))


@lru_cache(None)
def arcs(code: int) -> tuple[tuple[int, str, int, int], ...]:
    """(from, letter, to, cost) of a row by its code: initial s, u, a or another (0-3), and its fault times 4."""
    initial, fault = code & 3, code >> 2
    out = [(s, "D", s, DELETE) for s in STATES]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        kept = {0: [(START, AFTER_S)], 1: [t for t in TURNS if t[1] == AFTER_U], 2: [(AFTER_U, AFTER_A)]}.get(initial, [])
        out += [(a, "K", b, extra) for a, b in kept] + [(a, "R", b, extra + REROLE) for a, b in TURNS]
    return tuple(out)


def _inserted(costs: list[int], back: bool = False) -> list[int]:
    """Costs with any turns inserted here."""
    for _ in range(3):
        for a, b in TURNS:
            a, b = (b, a) if back else (a, b)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return costs


def forward(codes: Sequence[int], start: Sequence[int]) -> list[list[int]]:
    out = [_inserted(list(start))]
    for code in codes:
        now, after = out[-1], [NEVER] * 4
        for a, _, b, w in arcs(code):
            after[b] = min(after[b], now[a] + w)
        out.append(_inserted(after))
    return out


def backward(codes: Sequence[int], end: Sequence[int]) -> list[list[int]]:
    out = [_inserted(list(end), back=True)]
    for code in reversed(codes):
        now, before = out[-1], [NEVER] * 4
        for a, _, b, w in arcs(code):
            before[a] = min(before[a], now[b] + w)
        out.append(_inserted(before, back=True))
    return out[::-1]


BEGIN = [0, NEVER, NEVER, NEVER]
END = [0, NEVER, NEVER, 0]


def matrix(codes: Sequence[int]) -> list[int]:
    """A block's least costs from each state to each, row by row."""
    return [c for s in STATES for c in forward(codes, [0 if s == k else NEVER for k in STATES])[-1]]


class TightArcs:
    """The arcs of a block that lie on some cheapest path of its conversation."""

    def __init__(self, codes: Sequence[int], start: Sequence[int], end: Sequence[int]) -> None:
        self.codes, self.fore, self.back = codes, forward(codes, start), backward(codes, end)
        self.cost = min(f + b for f, b in zip(self.fore[0], self.back[0], strict=True))

    def least(self, frontier: int, last: bool) -> tuple[list[list[tuple[str, int]]], int]:
        """By row the least letters from a set of states (bits), each with the state it leads
        to, what is inserted before the row first; at the end (``last``) one more list. And
        the set of states after them."""
        out, cost = [], self.cost
        for k in range(len(self.codes) + last):
            fore, back, letters = self.fore[k], self.back[k], []
            row = arcs(self.codes[k]) if k < len(self.codes) else ()
            after = self.back[k + 1] if row else None
            while frontier:
                if not row and any(frontier >> s & 1 and back[s] == 0 and END[s] == 0 for s in STATES):
                    break
                found: dict[str, int] = {}
                for a, b in TURNS:
                    if frontier >> a & 1 and fore[a] + INSERT + back[b] == cost:
                        found["I"] = found.get("I", 0) | 1 << b
                for a, letter, b, w in row:
                    if frontier >> a & 1 and fore[a] + w + after[b] == cost:
                        found[letter] = found.get(letter, 0) | 1 << b
                if not found:
                    frontier = 0
                    break
                letter = min(found)
                frontier = found[letter]
                letters.append((letter, frontier.bit_length() - 1))
                if letter != "I":
                    break
            out.append(letters)
        return out, frontier


@lru_cache(1 << 16)
def _whole(codes: bytes) -> tuple[list, int]:
    arcs_ = TightArcs(codes, BEGIN, END)
    return arcs_.least(1, last=True)[0], arcs_.cost


EDITS = "g string, pos long, turn long, code int, edits array<struct<edit:string,role:string>>, audit string, cost long"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with a head each where their conversation has several -> the edits of each row, and their letters in a block's first."""
    kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
    names = [x.split()[0] for x in EDITS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), kind, pa.string(), pa.int64()]
    out: list[list] = [[] for _ in names]

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
        for x in out:
            x.clear()
        return found

    for (g, _), rows in blocks_of(batches, 2):
        pos, turns, codes = (rows.column(c).to_pylist() for c in ("pos", "turn", "code"))
        if codes[0] is None:
            fore, back, entry, last = (rows.column(c)[0].as_py() for c in ("fore", "back", "entry", "last"))
            pos, turns, codes = pos[1:], turns[1:], codes[1:]
            tight = TightArcs(codes, fore, back)
            found, cost = tight.least(entry, last)[0], tight.cost
        elif len(codes) <= 64:
            found, cost = _whole(bytes(codes))
        else:
            tight = TightArcs(codes, BEGIN, END)
            found, cost = tight.least(1, last=True)[0], tight.cost
        each = [[{"edit": x, "role": ROLE[s] if x in "IR" else None} for x, s in row] for row in found]
        if len(each) > len(pos):  # what is inserted after the last row goes with it
            each[len(pos) - 1 :] = [each[len(pos) - 1] + each[-1]]
        audit = "".join(letter for row in found for letter, _ in row)
        for x, more in zip(out, ([g] * len(pos), pos, turns, codes, each, [audit] + [None] * (len(pos) - 1), [cost] * len(pos)), strict=True):
            x.extend(more)
        if len(out[0]) >= 10_000:
            yield batch()
    if out[0]:
        yield batch()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (g, block), rows in blocks_of(batches, 2):
        yield pa.RecordBatch.from_pylist([{"g": g, "block": block, "matrix": matrix(rows.column("code").to_pylist())}])


def _fore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at the start of each block of a conversation."""
    g, at = None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            at = at if row["g"] == g else BEGIN
            g = row["g"]
            out.append({"g": g, "block": row["block"], "fore": at})
            m = row["matrix"]
            at = [min(NEVER, *(at[s] + m[4 * s + k] for s in STATES)) for k in STATES]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("block", pa.int64()), ("fore", pa.list_(pa.int64()))]))


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from the end of each block to the end of its conversation, the last block first."""
    g, at = None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            last = row["g"] != g
            at = END if last else at
            g = row["g"]
            out.append({"g": g, "block": row["block"], "back": at, "last": last})
            m = row["matrix"]
            at = [min(NEVER, *(m[4 * k + s] + at[s] for s in STATES)) for k in STATES]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("block", pa.int64()), ("back", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of states that each set at a block's start leads to."""
    for (g, block), rows in blocks_of(batches, 2):
        tight = TightArcs(rows.column("code").to_pylist()[1:], rows.column("fore")[0].as_py(), rows.column("back")[0].as_py())
        yield pa.RecordBatch.from_pylist([{"g": g, "block": block, "after": [tight.least(m, False)[1] for m in range(16)]}])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g, at = None, 1
    for b in batches:
        out = []
        for row in b.to_pylist():
            at = at if row["g"] == g else 1
            g = row["g"]
            out.append({"g": g, "block": row["block"], "entry": at})
            at = row["after"][at]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("block", pa.int64()), ("entry", pa.int64())]))


def _streamed(df: DataFrame, *order: Column) -> DataFrame:
    """Each conversation's rows in order, one after another in some task, which holds one batch of them."""
    return df.repartition("g").sortWithinPartitions("g", *order)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _heads(light: DataFrame) -> DataFrame:
    """For each block of a conversation that has several: costs before and after it, and its first frontier."""
    spans = light.groupBy("g").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b")
    rows = light.join(few(stored(spans.select("g"))), "g", "left_semi")
    blocks = stored(_dealt(rows.select("g", "block", "pos", "code")).mapInArrow(_matrices, "g string, block long, matrix array<long>"))
    fore = _streamed(blocks, F.col("block")).mapInArrow(_fore, "g string, block long, fore array<long>")
    back = _streamed(blocks, F.col("block").desc()).mapInArrow(_back, "g string, block long, back array<long>, last boolean")
    sides = stored(fore.join(back, ["g", "block"]))
    marked = rows.select("g", "block", "pos", "code").unionByName(sides.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    maps = _dealt(marked).mapInArrow(_maps, "g string, block long, after array<long>")
    entries = _streamed(maps, F.col("block")).mapInArrow(_entries, "g string, block long, entry long")
    return stored(sides.join(entries, ["g", "block"]))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> counts by conversation and the letters of its blocks, joined."""
    g, out, now = None, [], {}

    def row() -> dict:
        span = 0 if now["first"] is None else now["turn"] - now["first"] + 1 - now["turns"]
        return {"g": g, "gaps": span, **{n: now["faults"][k] for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))}, "illegal": now["illegal"], "cost": now["cost"], "audit": "".join(now["audit"])}

    names = ["g", *[x.split()[0] for x in COUNTS.split(", ")]]
    schema = pa.schema([(n, pa.string() if n in ("g", "audit") else pa.int64()) for n in names])
    for b in batches:
        for x, turn, code, cost, audit in zip(*[b.column(n).to_pylist() for n in ("g", "turn", "code", "cost", "audit")], strict=True):
            if x != g:
                if g is not None:
                    out.append(row())
                g, now = x, {"first": None, "turn": None, "turns": 0, "faults": [0] * 4, "illegal": 0, "initial": None, "cost": cost, "audit": []}
            if turn is not None and turn != now["turn"]:
                now["first"], now["turn"], now["turns"] = turn if now["first"] is None else now["first"], turn, now["turns"] + 1
            now["faults"][code >> 2] += 1
            if now["initial"] is not None and (now["initial"], code & 3) not in ((0, 1), (1, 2), (2, 1)):
                now["illegal"] += 1
            now["initial"] = code & 3
            if audit is not None:
                now["audit"].append(audit)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if g is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> the digest of each conversation's, joined by line feeds; none is held."""
    g, h, out = None, None, []
    schema = pa.schema([("g", pa.string()), ("sha256", pa.string())])
    for b in batches:
        for x, line in zip(b.column("g").to_pylist(), b.column("line"), strict=True):
            if x != g:
                if g is not None:
                    out.append({"g": g, "sha256": h.hexdigest()})
                g, h = x, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(line.as_buffer())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if g is not None:
        yield pa.RecordBatch.from_pylist([{"g": g, "sha256": h.hexdigest()}], schema)


def conversation_key(conv: Column) -> Column:
    """A string by conversation, null ones being one."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations (``g``, see ``conversation_key``) and their repaired turns.

    Rows go by turn, null first, then by role and the digest of role and text. The first
    table has ``g, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row for each conversation that has rows;
    the second ``g, pos, place, edit, role, text`` for every turn that is kept, reroled (with its new role) or inserted (with
    an empty text), in the order of ``pos`` and ``place``.

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and
    text stood earlier), truncated (the last other character is none of ``.!?``). Roles
    go by their first character. Null roles and texts count as one space, null
    conversations are one, null turns come first and make no gap. Repeated rows are
    duplicates. Texts and conversations may have any length; ``row_col`` is a unique long
    that deals equal rows out (else rows are numbered). An empty table gives no rows;
    columns not named are not read.
    """
    src = pick(df, conv_=conv_col, turn_=turn_col, role_=role_col, text_=text_col, **({"row_": row_col} if row_col else {}))
    src = src if row_col else numbered(src, "row_")
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = src.select(conversation_key(F.col("conv_")).alias("g"), F.col("turn_").cast("long").alias("turn"), spaced("role_").alias("role"), spaced("text_").alias("text"), F.col("row_").alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("own", F.when(bare == "", F.lit(BLANK)).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(0)))
    rows = in_order(rows, F.col("g"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row"))
    twice = stored(rows.groupBy("g", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "digest", "first"))
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when((F.col("own") != BLANK) & (F.col("pos") > F.col("first")), F.lit(DUPLICATE)).otherwise(F.col("own"))
    code = (F.when(initial == 0, F.lit(3)).otherwise(initial - 1) + fault * 4).cast("int")
    light = rows.select("g", "digest", "pos", "turn", "role", "own").join(few(twice), ["g", "digest"], "left")
    light = stored(light.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "turn", code.alias("code")))
    heads = _heads(light).withColumn("pos", F.lit(-1).cast("long"))
    marked = light.unionByName(heads, allowMissingColumns=True)
    edits = stored(_dealt(marked).mapInArrow(_edit, EDITS))
    summary = _streamed(edits.drop("edits"), F.col("pos")).mapInArrow(_summary, f"g string, {COUNTS}")
    turns = rows.select("pos", "role", "text").join(edits.select("g", "pos", "edits"), "pos").select("g", "pos", "role", "text", F.posexplode("edits").alias("place", "e"))
    turns = turns.where("e.edit <> 'D'").select(
        "g", "pos", "place", F.col("e.edit").alias("edit"), F.coalesce("e.role", "role").alias("role"), F.when(F.col("e.edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text")
    )
    return summary, turns


def turns_digest(turns: DataFrame) -> DataFrame:
    """``g, sha256`` of each conversation's ``role:text`` lines. A digest takes its bytes in order, so a conversation passes through one task, as a stream."""
    lines = turns.select("g", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return _streamed(lines, F.col("pos"), F.col("place")).mapInArrow(_digests, "g string, sha256 string")
