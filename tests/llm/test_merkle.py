"""Manifests against a plain tree, the traversal against it, and its bounds."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import merkle
from tensorloom.llm.merkle import Subtree, height_of, node, paths
from tensorloom.llm.queries import QUERIES


def levels(digests):
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([node(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_path(tree, place):
    out = []
    for level in tree[:-1]:
        there = place ^ 1 < len(level)
        out.append(("L" if place & 1 else "R") + level[place ^ 1] if there else "-")
        place >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33, 100])
@pytest.mark.parametrize("band", [1, 2, 3, 5])
def test_traversal(n, band):
    leaves = [node(str(k)) for k in range(n)]
    tree = levels(leaves)
    assert list(paths(leaves, height_of(n), band)) == [plain_path(tree, k) for k in range(n)]
    assert Subtree(leaves, 0, height_of(n), height_of(n)).grown().root == tree[-1][0]


def test_traversal_holds_few_nodes(monkeypatch):
    trees = []
    start = Subtree.__init__
    monkeypatch.setattr(Subtree, "__init__", lambda self, *a: (start(self, *a), trees.append(self))[0])
    leaves, most = [node(str(k)) for k in range(1024)], 0
    for _ in paths(leaves, 10, 2):
        live = trees[-10:] if len(trees) > 10 else trees
        most = max(most, sum(len(t.stack) for t in live))
    assert max(len(t.nodes) for t in trees) <= 6 and most <= 10 * 10


def plain(rows, tampered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = []
    for doc_id, text, lang, source, n_chars in rows:
        hit = tampered and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        leaf, claim = (node(*map(field, (doc_id, source, lang, n, text))) for n in (n_chars, n_chars + 1 if hit else n_chars))
        made.append((("" if lang is None else "=" + lang).encode(), doc_id is not None, doc_id or 0, leaf, claim, doc_id))
    made.sort(key=lambda x: x[:4])
    groups = {}
    for x in made:
        groups.setdefault(x[0], []).append(x)
    trees = {g: levels([x[3] for x in v]) for g, v in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for place, (g, v) in enumerate(groups.items()):
        for k, x in enumerate(v):
            path = plain_path(trees[g], k) + plain_path(top, place)
            at = x[4]
            for s in path:
                at = node(s[1:], at) if s[0] == "L" else node(at, s[1:]) if s[0] == "R" else node(at)
            out.append((-1 if x[5] is None else x[5], x[3], trees[g][-1][0], top[-1][0], node(*[s[1:] for s in path]), at, at == top[-1][0]))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_query_against_a_plain_tree(spark, folder, frame, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK", bits)
    assert rows_of(QUERIES["op12_merkle"](spark, folder)) == plain(frame, True)


def test_many_groups_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, f"text {k}", rng.choice([None, "a", "b", "é", *map(str, range(9))]) if k % 3 else "a", "s", k) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    monkeypatch.setattr(merkle, "BLOCK", 2)
    found = merkle.manifest(df)
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("leaf"), F.col("path")).alias("x")).withColumn("ok", F.col("x") == F.col("root"))
    assert rows_of(out) == plain(rows, False)


def test_one_row_is_its_own_root(spark, one_text):
    row = merkle.manifest(one_text("alone")).first()
    assert row.leaf == row.subroot == row.root and row.path == []


def test_any_changed_field_is_seen(spark, one_text):
    a = merkle.manifest(one_text("x", "y", "z")).first().root
    assert a != merkle.manifest(one_text("x", "y", "zz")).first().root
    assert a == merkle.manifest(one_text("x", "y", "z").repartition(3)).first().root
