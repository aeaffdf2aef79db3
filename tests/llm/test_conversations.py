"""Repairs against a search over all edits, in one block and in many."""

import hashlib
import heapq
import random
import zlib

import pytest

from tensorloom.llm import conversations
from tensorloom.llm.queries import OP13_ORACLE, QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        say = lambda x: " " if x is None else str(x)
        c = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        role = "user" if c == 4 else role
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        out += [(conv, turn, role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """The cheapest and then least edits by a uniform-cost search over (cost, letters)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, k, state, out = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, letters, "\n".join(out)
        role, after = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 5, letters + "I", k, after, (*out, role + ":")))
        if k < len(rows):
            _, _, own, text = rows[k]
            heapq.heappush(heap, (cost + 2, letters + "D", k + 1, state, out))
            if wrong[k] not in ("blank", "duplicate"):
                extra = 5 if wrong[k] == "truncated" else 0
                heapq.heappush(heap, (cost + extra + 1, letters + "R", k + 1, after, (*out, f"{role}:{text}")))
                to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(own[:1])
                if to:
                    heapq.heappush(heap, (cost + extra, letters + "K", k + 1, to, (*out, f"{own}:{text}")))
    raise AssertionError


def plain(rows):
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        wrong, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, letters, text = cheapest(own, wrong) if own else (0, "", "")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((-1 if conv is None else conv, gaps, *[wrong.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.conv_id is None else r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def some(seed, n_conv, length):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "usher"], ["Fine.", "Well!", "so what", "", " \t", None, "Is it? ", "été…", "ok.\n"]
    rows = []
    for c in range(n_conv):
        turn = rng.randrange(3)
        for k in range(rng.randint(1, length)):
            role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((None if c == 1 else c, None if rng.random() < 0.05 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"line {k}.", "clash"))
            turn += rng.choice([0, 1, 1, 1, 3])
    rng.shuffle(rows)
    return [*rows, rows[0], rows[0]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def write(rows):
        path = str(tmp_path_factory.mktemp("conversations"))
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
        return path

    return write


@pytest.mark.parametrize("block", [4096, 7])
def test_against_a_search(spark, tables, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = some(11, 120, 14)
    assert found(QUERIES["op13_conversations"](spark, tables(rows))) == plain(rows)


def test_one_long_conversation_over_many_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rows = [(3 if k % 4 else k, *r[1:]) for k, r in enumerate(some(5, 60, 12))]
    assert found(QUERIES["op13_conversations"](spark, tables(rows))) == plain(rows)


def test_sql_says_the_same(spark, tables):
    import duckdb

    rows = some(7, 80, 9)
    path = tables(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    cursor = con.execute(OP13_ORACLE)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted((-1 if r["conv_id"] is None else r["conv_id"], *[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]) for r in want) == plain(rows)


def test_turns_are_returned(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And?")], "conv_id long, turn long, role string, text string")
    summary, turns = conversations.repair(df)
    assert [r.role + ":" + r.text for r in turns.orderBy("pos", "place").collect()] == ["user:Hi.", "assistant:Yes."]
    assert summary.first().audit == "RKD"


def test_empty_table(spark, tables, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    assert QUERIES["op13_conversations"](spark, path).count() == 0
    assert damaged(spark.read.parquet(f"{path}/conversations.parquet")).count() == 0
