"""The pipeline's stages against plain programs, each on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import Row
from tensorloom.llm import simhash
from tensorloom.llm.common import documents, table
from tensorloom.llm.quality import BOILERPLATE
from test_brute_force import grouped, words


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    both = len(a & b)
    return bool(both) and both >= 0.8 * (len(a) + len(b) - both)


def near_copies():
    """Documents of 200 words, some changed in one or two places, some in many."""
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(6)]
    out = []
    for k, b in enumerate(base):
        out.append(b)
        for n in (1, 2, 3, 40):
            c = list(b)
            for _ in range(n):
                c[rng.randrange(200)] = f"new{rng.randint(0, 9999)}"
            out.append(c)
    return [" ".join(x) + "." for x in out]


def cleaned(rows):
    """Rows that the quality rules keep, without their failing lines, by a plain program."""
    out = []
    for r in rows:
        w = words(r.text, lower=False)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + x for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for x in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        good = [x for x in lines if not fails(x)]
        lost = sum(len(words(x, lower=False)) for x in lines if fails(x))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * lost <= 30 * len(w):
            text = r.text if len(good) == len(lines) else "\n".join(good)
            out.append(r if text == r.text else Row(**{**r.asDict(), "text": text, "n_chars": len(text)}))
    return out


def fails(line):
    n = line.count(" ") + 1
    symbols, shouts = sum(line.count(c) for c in "#*$%&|<>{}"), len(line) - len(line.replace("!!", "!"))
    endless = n > 100 and not any(c in line for c in ".!?…。:;")
    menu = sum(line.count(c) for c in "»›·•") >= 3 or line.count("://") >= 3
    return symbols * 5 > n or shouts * 5 > n or endless or menu or any(p in line.lower() for p in BOILERPLATE)


def targets(sizes):
    """150 % of all sizes by weights 3, 1, 2, at most twice a source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_stages(spark, folder):
    docs = documents(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = table(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == corpus_pipeline.COLUMNS
        had, has = docs.select(*out.columns).collect(), out.collect()
        if name == "quality_rules":
            assert Counter(has) == Counter(cleaned(had))
        elif name == "exact_dedup":
            key = lambda r: re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")
            assert len(has) == len({key(r) for r in has}) and {key(r) for r in has} == {key(r) for r in had}
        elif name == "simhash_near_dedup":
            roots = grouped([shingles(r.text) for r in had], near)
            assert len(has) == len(set(roots))
        else:
            times, source_of = Counter(has), {r: r.source for r in had}
            assert all(n <= 2 * Counter(had)[r] for r, n in times.items())
            size = lambda r: len(words(r.text, lower=False))
            taken = Counter()
            for r, n in times.items():
                taken[source_of[r]] += n * size(r)
            whole = Counter()
            for r in had:
                whole[r.source] += size(r)
            longest = {s: max(size(r) for r in had if r.source == s) for s in whole}
            assert all(abs(taken[s] - t) <= longest[s] for s, t in targets(whole).items())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_near_duplicates_are_found_and_others_kept(spark, one_text):
    found = near_copies()
    roots = grouped([shingles(t) for t in found], near)
    kept = corpus_pipeline.near_duplicate_groups(spark, one_text(*found), "").collect()
    assert len(kept) == len(set(roots)) and {roots[r.doc_id] for r in kept} == set(roots)


def test_near_duplicate_chains_in_buckets_of_several_blocks(spark, one_text, monkeypatch):
    """Chains in which the nearest neighbour is not always a near-duplicate, with buckets
    that are dealt out by pairs of blocks."""
    import random

    monkeypatch.setattr(simhash, "SPLIT", 7)
    rng = random.Random(8)
    found = []
    for b in range(4):
        text = [f"w{b}x{rng.randint(0, 900)}" for _ in range(120)]
        for _ in range(25):
            text = list(text) if rng.random() < 0.6 else [*text[:-3], *[f"n{rng.randint(0, 10**6)}" for _ in range(3)]]
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
            found.append(" ".join(text))
    rng.shuffle(found)
    roots = grouped([shingles(t) for t in found], near)
    got = {r.row: r.root for r in simhash.near_duplicates(one_text(*found), row_col="doc_id").collect()}
    assert [got.get(k, k) for k in range(len(found))] == roots


def test_rounds_that_link_few_rows_end_and_nothing_is_lost(spark, one_text, monkeypatch):
    """A long chain links a few rows a round; the whole buckets find what the rounds that are left out would have."""
    import random

    rng, rounds, pairs = random.Random(9), [], simhash._pairs_in_buckets
    monkeypatch.setattr(simhash, "WORTHWHILE", 1)
    monkeypatch.setattr(simhash, "_pairs_in_buckets", lambda *a: rounds.append(a) or pairs(*a))
    found = []
    for b in range(3):
        text = [f"w{b}x{k}" for k in range(120)]
        for _ in range(30):
            text = list(text)
            text[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
            found.append(" ".join(text))
    rng.shuffle(found)
    roots = grouped([shingles(t) for t in found], near)
    got = {r.row: r.root for r in simhash.near_duplicates(one_text(*found, *[f"other {k} of its own kind here" for k in range(9)] * 2), row_col="doc_id").collect()}
    assert [got.get(k, k) for k in range(len(found))] == roots
    assert len(rounds) <= 3


def test_no_link_is_lost_where_nearest_candidates_fail(spark, one_text, monkeypatch):
    """All members of a bucket look alike to SimHash, so the nearest is hardly ever the near-duplicate."""
    import numpy as np

    monkeypatch.setattr(simhash, "fingerprint", lambda hashes: 0)
    sketch = simhash._sketch

    def one_bucket(*a):
        run = sketch(*a)

        def keys(batches):
            import pyarrow as pa

            for b in run(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows, dtype=np.int64)), pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))], ["row", "fp", "keys"])

        return keys

    monkeypatch.setattr(simhash, "_sketch", one_bucket)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(24)]
    found = [*texts, *[t + " more" for t in reversed(texts)]]
    roots = grouped([shingles(t) for t in found], near)
    got = {r.row: r.root for r in simhash.near_duplicates(one_text(*found), row_col="doc_id", tries=len(found)).collect()}
    assert [got.get(k, k) for k in range(len(found))] == roots


@pytest.mark.parametrize("limits", [{}, {"SPLIT": 7}, {"SPLIT_SHINGLES": 300, "AT_ONCE": 3}])
def test_no_candidate_is_left_out_by_default(spark, one_text, monkeypatch, limits):
    """One bucket whose fingerprints are all alike: every row has many nearer candidates that fail."""
    import numpy as np
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    sketch = simhash._sketch

    def one_bucket(*a):
        run = sketch(*a)

        def keys(batches):
            for b in run(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows, dtype=np.int64)), pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))], ["row", "fp", "keys"])

        return keys

    monkeypatch.setattr(simhash, "_sketch", one_bucket)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(24)]
    found = [*texts, *[t + " more" for t in reversed(texts)], *[t + " more and more" for t in texts[::3]]]
    roots = grouped([shingles(t) for t in found], near)
    got = {r.row: r.root for r in simhash.near_duplicates(one_text(*found), row_col="doc_id").collect()}
    assert [got.get(k, k) for k in range(len(found))] == roots
