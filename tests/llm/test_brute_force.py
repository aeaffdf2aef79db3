"""Operators that SQL cannot express, against the plainest program for the same."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tensorloom.llm import langid, lsm_dedup, mixing, packing, pst, simhash, suffix_dedup
from tensorloom.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = (text or "").translate(UPPER) if lower else text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def table(frame):
    return [r[:2] for r in frame]


def fold(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def removed(texts, length, n_words):
    """Digest columns of suffix_dedup by counting all strings, and all units of over ``n_words`` words."""
    bodies = [(t or "").encode() for t in texts]
    found = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    spans = []
    for b in bodies:
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        ends = [at[k + n_words][1] if k + n_words < len(at) else len(b) + length for k in range(len(at))]
        spans.append([(a, min(e, a + length)) for (a, _), e in zip(at, ends, strict=True) if min(e, a + length) <= len(b)])
    rows = Counter(u for b, own in zip(bodies, spans, strict=True) for u in {b[i:j] for i, j in own})
    out = []
    for b, own in zip(bodies, spans, strict=True):
        mark = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if found[b[i : i + length]] > 1:
                mark[i : i + length] = True
        passages = []
        for i, j in own:
            if rows[b[i:j]] > 1:
                if passages and i <= passages[-1][1]:
                    passages[-1][1] = max(passages[-1][1], j)
                else:
                    passages.append([i, j])
        if bodies.count(b) > 1 and own:  # a copy is one passage from end to end
            passages = [[0, len(b)]]
        left = bytes(x for x, m in zip(b, mark[:-1], strict=True) if not m)
        runs = int((mark[:-1] & ~np.concatenate(([False], mark[:-2]))).sum()) if b else 0
        out.append((len(b), int(mark.sum()), runs, hashlib.sha256(left).hexdigest(), len(passages), sum(len(b[i:j].split()) for i, j in passages)))
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "BLOCK": 300, "CORES": (8, 2, 1), "CHUNK": 512}, {"HOT": 2, "HOTTER": 4, "HEAVY": 8}])
def test_repeated_passages(one_text, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(1)
    letters = np.array(list("abcde é"))
    text = lambda n: "".join(rng.choice(letters, n))
    shared = [text(n) for n in (30, 40, 45, 60, 120)]
    phrase = "a be c de fg h ij k lm n o"
    found = [text(rng.integers(60)) + shared[rng.integers(5)] + text(rng.integers(60)) + shared[rng.integers(5)] for _ in range(80)]
    found += [f"{text(20)} {phrase} {text(rng.integers(30))}" for _ in range(9)] + [phrase, phrase + "x", "x" + phrase, f"{phrase}\n{phrase}"]
    found += ["a" * 100, "ab" * 400, "a" * 101, None, "", shared[4], shared[4], text(20), *[text(1500)] * 2, "x" + text(900) * 2, *[f"{x} {x[:70]} {x[:60]} {text(9)} {x[20:]}" for x in (text(90), text(110))], "a b c d e f g h i", "a b c d e f g h i"]
    got = suffix_dedup.remove_repeats(one_text(*found).repartition(3), length=40, gram=16, words=8).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == removed(found, 40, 8)


def test_repeated_passages_of_the_query(spark, folder, frame):
    rows = table(frame)
    want = Counter((d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows], 400, 50), strict=True))
    assert Counter(tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, folder).collect()) == want


def test_repeated_passages_of_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows], 400, 50), strict=True))
    assert Counter(tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()) == want


def test_copies_are_neither_hashed_nor_cut(one_text, monkeypatch):
    """Disk: one row of each text goes on to the anchors and fragments."""
    written = {}

    def kept(df, label, write=suffix_dedup.table):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(suffix_dedup, "table", kept)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcde "), 300))
    found = [text] * 5 + [text[50:] + "x", None, text[:20]]
    got = suffix_dedup.remove_repeats(one_text(*found), length=40, gram=16, words=8).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == removed(found, 40, 8)
    assert written["anchors"].count() == 2


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    for top in (1, 2, 3, 256):
        for _ in range(40):
            symbols = np.where(rng.random(rng.integers(1, 70)) < 0.9, rng.integers(1, top + 1, 1), 0)
            symbols = np.concatenate((np.where(symbols, rng.integers(1, top + 1, len(symbols)), 0), [0]))
            reach = np.array([min(7, next(k for k in range(i, len(symbols)) if symbols[k] == 0) - i) for i in range(len(symbols))])
            with np.errstate(over="ignore"):
                order = suffix_dedup.suffix_array(symbols, reach)
            heads = [(tuple(symbols[i : i + reach[i]]) + (0,) * 7)[:7] for i in order]
            assert sorted(order) == list(range(len(symbols))) and heads == sorted(heads)


def test_language_identification(spark, folder, frame):
    got = QUERIES["op5_langid"](spark, folder).collect()
    assert len(got) == len(frame)
    for r in got:
        assert r.held_out == fold(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "de", "und")
    want = Counter((d, not any(c.isalpha() for c in t or "")) for d, t in table(frame))
    assert Counter((r.doc_id, r.lang_pred == "und") for r in got) == want


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op5_langid"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_forward_sums_all_segmentations():
    import public_tokenizers

    pieces = langid.Pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T)

    def brute(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in pieces.ids:
                out += np.exp(logs[pieces.ids[word[:k]]]) * brute(word[k:])
            elif k == 1:
                out += np.exp(logs[[pieces.bytes[b] for b in word[:1].encode()]].sum(axis=0)) * brute(word[1:])
        return out

    some = ["▁the", "▁garden", "▁été", "▁ⓐx", "▁"]
    long = "▁" + "unbelievablytheweatherings" * 3  # over the length of any piece, by a plain recurrence
    steps = [np.ones(2)]
    for k in range(1, len(long) + 1):
        steps.append(sum(np.exp(logs[pieces.ids[long[i:k]]]) * steps[i] for i in range(max(0, k - 16), k) if long[i:k] in pieces.ids))
    np.testing.assert_allclose(langid.forward([long, "▁the"], pieces, logs)[0], np.log(steps[-1]))
    np.testing.assert_allclose(langid.forward(some, pieces, logs), [np.log(brute(w)) for w in some])


def test_language_model(spark, folder, frame):
    rows = table(frame)
    training = [[*words(t), " "] for d, t in rows if not fold(d, 10, 0)]
    counts = Counter(w for t in training for w in t)
    total, distinct = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    want = sorted((d is None, d or 0, fold(d, 10, 0), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), " "]), total, round(sum(map(log, [*words(t), " "])), 6)) for d, t in rows)
    got = QUERIES["op6_lm_score"](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def plain_suffix_tree(training, depth, least, discount, divergence):
    """Score of a word after a history, by dictionaries of tuples."""
    counts = Counter(w for t in training for w in t)
    total, distinct = sum(counts.values()), len(counts)
    with_id = {w for w, n in counts.items() if n >= 2 or w == " "}
    base = lambda w: (counts[w] + 0.1) / (total + 0.1 * (distinct + 1))
    grams = [Counter({(w,): n for w, n in counts.items() if n >= least and w in with_id})]
    nodes = [{}]
    best = [{g: base(g[0]) for g in grams[0]}]
    for d in range(1, depth + 1):
        found = Counter(tuple(t[k : k + d + 1]) for t in training for k in range(len(t) - d))
        grams.append(Counter({g: n for g, n in found.items() if n >= least and g[:-1] in grams[-1] and g[1:] in grams[-1]}))
        nodes.append({})
        for c, n in grams[-2].items():
            after = {g[-1]: (k - discount) / n for g, k in grams[-1].items() if g[:-1] == c}
            if not after:
                continue
            parent = {w: best[-1][(*c[1:], w)] for w in after}
            left, rest = (max(1e-12, 1 - sum(x.values())) for x in (after, parent))
            if sum(p * math.log(p / parent[w]) for w, p in after.items()) + left * math.log(left / rest) >= divergence:
                nodes[-1][c] = (after, left / rest)
        if not nodes[-1]:
            break
        best.append({g: nodes[-1][g[:-1]][0][g[-1]] if g[:-1] in nodes[-1] else best[-1][g[1:]] for g in grams[-1]})

    def p(history, w):
        out = base(w)
        for d in range(1, len(nodes)):
            after, weight = nodes[d].get(tuple(history[-d:]) if len(history) >= d else None, (None, None))
            if after is not None:
                out = after[w] if w in after else weight * out
        return out

    return p, nodes


def test_suffix_tree_scores(spark, one_text):
    """Scores equal those of a plain program, with contexts of up to three words; each state is a distribution."""
    rng = np.random.default_rng(3)
    lines = ["a b c a b d a b c e a b ", "c c d ", "x a b c y ", "q a b c z ", "x a b d "]
    found = ["".join(lines[k] for k in rng.integers(0, len(lines), 40)) for _ in range(25)] + ["once twice", None, "a b c", "x a b c Y new"]
    split = lambda t: [*words(t), " "]
    p, nodes = plain_suffix_tree([split(t) for t in found], 3, 5, 0.5, 1e-3)
    assert all(nodes[d] for d in (1, 2, 3))
    got = pst.score(one_text(*found), pst.F.lit(True), depth=3, least=5, divergence=1e-3, word_part=0.0, context_part=0.0).collect()
    for r in got:
        t = split(found[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(t[:k], w)) for k, w in enumerate(t)), abs=1e-6)
    counts = Counter(w for t in found for w in split(t))
    for c in [c for level in nodes for c in level]:
        assert sum(p(list(c), w) for w in [*counts, "unseen"]) == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("parts", [{"word_part": 0.02, "context_part": 0.02}, {"word_part": 1.0, "context_part": 1.0, "block": 60}, {"word_part": 0.1, "context_part": 0.07, "block": 200}])
def test_suffix_tree_has_the_rare_runs(spark, one_text, parts):
    """What is a small part of all tokens is in the tree too, whether levels are sent or blocks ask for their keys."""
    rng = np.random.default_rng(4)
    lines = ["a b c a b d a b c e a b ", "c c d ", "x a b c y ", "q a b c z ", "x a b d "]
    found = ["".join(lines[k] for k in rng.integers(0, len(lines), 40)) for _ in range(20)] + ["r s t v s u " * 4, "once twice", None, "a b c", "r s t x a b c Y new"]
    split = lambda t: [*words(t), " "]
    held_out = lambda k: k % 7 == 5
    p, nodes = plain_suffix_tree([split(t) for k, t in enumerate(found) if not held_out(k)], 3, 3, 0.5, 1e-3)
    assert ("r",) in nodes[1] and ("r", "s") in nodes[2]
    got = pst.score(one_text(*found), pst.F.col("doc_id") % 7 != 5, depth=3, least=3, divergence=1e-3, **parts).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(found)))
    for r in got:
        t = split(found[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(t[:k], w)) for k, w in enumerate(t)), abs=1e-6)


def test_workers_need_not_have_the_package(folder, tmp_path):
    """Queries whose functions and models go to workers that cannot import this repository."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from tensorloom.llm.queries import QUERIES
def hidden(batches):
    import importlib.util
    assert importlib.util.find_spec("tensorloom") is None
    yield from batches
spark.range(3).mapInArrow(hidden, "id long").count()
for name in ("op4_suffix_dedup", "op5_langid", "op6_lm_score", "op8_packing", "op9_exact_dedup", "op10_simhash"):
    QUERIES[name](spark, {folder!r}).count()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_packing(spark, folder, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for d, t in table(frame)]
    got = QUERIES["op8_packing"](spark, folder).collect()
    by_id = {d: x for d, x in ids}
    for r in got:
        if r.doc_id is not None:
            x = by_id[r.doc_id]
            assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0) and r.length > 0
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def plain_packer(sizes, window):
    """Fills after each placement by trying every one, of equal sums the fullest; whole windows come off first."""
    open_, out = Counter(), []
    for n in sizes:
        n %= window
        if n:
            tried = {}
            for h in [0, *[h for h in open_ if open_[h] and h + n <= window]]:
                after = Counter(open_)
                after[h] -= h > 0
                after[h + n] += h + n < window
                tried[h] = sum(x * x for x in after.values())
            best = max(h for h, x in tried.items() if x == min(tried.values()))
            open_[best] -= best > 0
            open_[best + n] += best + n < window
        out.append({h: k for h, k in open_.items() if k})
    return out


def test_sum_of_squares_rule():
    """Each document goes where the sum of squared counts becomes smallest, to the token; windows close by placement alone."""
    rng = np.random.default_rng(4)
    sizes = [int(n) for n in rng.integers(1, 200, 600)]
    packer = packing.SumOfSquares(window=64)
    for n, want in zip(sizes, plain_packer(sizes, 64), strict=True):
        packer.add("d", bytes(4 * n))
        assert {h: int(k) for h, k in enumerate(packer.counts) if k} == want
        assert packer.held == sum(h * k for h, k in want.items())
    packer.finish()
    lengths = [sum(p[2] for p in w) for w in packer.drain()]
    assert sum(lengths) == sum(sizes) and all(n <= 64 and n & (n - 1) == 0 for n in lengths) and sum(n < 64 for n in lengths) <= 6
    assert packer.whole == sum(n // 64 for n in sizes) and packer.placed > 2 * packer.merged


def test_open_windows_are_merged_beyond_their_tokens(monkeypatch):
    """Documents of which no two fit a window are cut once too many tokens are held."""
    monkeypatch.setattr(packing, "HELD", 40 * 1100)
    packer = packing.SumOfSquares()
    for k in range(2000):
        packer.add(k, bytes(4 * 1100))
        assert packer.held <= 40 * 1100
    packer.finish()
    pieces = sorted((p[0], p[1], p[2]) for w in packer.drain() for p in w)
    at = {}
    for d, start, n in pieces:
        assert at.get(d, 0) == start
        at[d] = start + n
    assert at == dict.fromkeys(range(2000), 1100)


def test_packed_sequences_against_a_plain_packer(spark, one_text):
    """One task's whole result: lengths of sequences by a program that only counts."""
    rng = np.random.default_rng(9)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(1, 3000, 150)]
    got = packing.pack(one_text(*texts).coalesce(1), window=2048).collect()
    totals = Counter()
    for r in got:
        totals[r.sequence_id] += r.length
    sizes = [len(t.split(" ")) + 1 for t in texts]
    left = sum(h * k for h, k in plain_packer(sizes, 2048)[-1].items())
    assert sum(n == 2048 for n in totals.values()) == (sum(sizes) - left) // 2048 + left // 2048
    assert sum(n for n in totals.values() if n < 2048) == left % 2048 == sum(sizes) % 2048
    cut = {r.doc_id for r in got if r.start and r.start % 2048}
    assert cut <= {r.doc_id for r in got if r.length % 2048}


def test_colliding_digests_are_told_apart(one_text, frame):
    df = one_text(*[t for _, t in table(frame)])
    plain = lsm_dedup.exact_dedup(df).drop("digest", "row").collect()
    weak = lsm_dedup.exact_dedup(df, digest=lambda b: b[:1].ljust(16, b".")).drop("digest", "row").collect()
    assert sorted(plain) == sorted(weak)


def test_index_keeps_every_key():
    index = lsm_dedup.LsmIndex(memtable=7, fanout=2)
    rng = np.random.default_rng(0)
    want = {}
    for row, k in enumerate(rng.integers(0, 90, 500).tolist()):
        key, value = hashlib.sha256(bytes([k])).digest(), ((-(row % 5), False, row % 13, row), 1, 1)
        want[key] = lsm_dedup.LsmIndex.merged(want[key], value) if key in want else value
        index.put(key, value)
    assert dict(index.items()) == want and [k for k, _ in index.items()] == sorted(want)


def test_index_runs_hold_no_objects_an_entry():
    index = lsm_dedup.LsmIndex(memtable=1000)
    for row in range(20_000):
        index.put(hashlib.sha256(str(row).encode()).digest(), ((-row, row % 7 == 0, row, row), 1, 1))
    held = sum(len(r.keys) + 8 * len(r.ends) + 8 * len(r.numbers) + len(r.live) + r.bloom.data.nbytes for r in index.runs)
    assert sum(len(r) for r in index.runs) == 20_000 and held < 100 * 20_000


def test_index_partitions_grow_with_the_entries(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2000) AS text")
    plain = lsm_dedup.exact_dedup(df).drop("row").collect()
    monkeypatch.setattr(lsm_dedup, "INDEXED", 100)
    assert sorted(lsm_dedup.exact_dedup(df).drop("row").collect()) == sorted(plain)


def test_index_returns_every_group_over_several_batches(spark):
    df = spark.range(45_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    assert lsm_dedup.exact_dedup(df).count() == 45_000


def simhash_of(text):
    w = words(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, near):
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(items))]


def test_simhash_components(spark, folder, frame):
    rows = table(frame)
    prints = [simhash_of(t) for _, t in rows]
    roots = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    want = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(tuple(x) for x in QUERIES["op10_simhash"](spark, folder).collect()) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 20])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = int(rng.integers(1 << 62))
    prints = [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(90)]
    slices = simhash.BitSlices(prints)
    for q in prints[:20]:
        assert slices.near(q, radius) == sum(1 << k for k, p in enumerate(prints) if (p ^ q).bit_count() <= radius)


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 3)
    rng = np.random.default_rng(9)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)})
    links = simhash.links_of(spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long"), 2)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    roots = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert all(got.get(p, p) == prints[r] for p, r in zip(prints, roots, strict=True))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99), (100, 98)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98}


def test_components_joined_by_further_links(spark):
    rng = np.random.default_rng(3)
    roots, every = spark.createDataFrame([], "node long, root long"), []
    for n in (40, 25, 1, 30):
        links = [tuple(sorted(x)) for x in rng.integers(0, 150, (n, 2)).tolist() if x[0] != x[1]] or [(0, 1)]
        every += links
        roots = simhash._joined_by(roots, spark.createDataFrame(links, "a long, b long"), len(links)).checkpoint()
        want = simhash.components(spark.createDataFrame(every, "a long, b long"))
        assert sorted(roots.collect()) == sorted(want.collect())


def test_empty_documents_are_mixed_at_most_twice(spark):
    """Where a source may give all it has twice, its empty documents go no oftener."""
    rows = [(k, "" if k % 8 == 0 else "w " * 5, "en", "a" if k < 20 else "b", 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = mixing.mix_sources(df, weights=(5, 1)).select("copies", "size").collect()
    assert max(r.copies for r in copies) == 2 and all(0 <= r.copies <= 2 for r in copies)
