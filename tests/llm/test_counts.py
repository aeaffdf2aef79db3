"""Token counts against the libraries themselves, and the cache's life."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import token_counts
from tensorloom.llm.queries import QUERIES
from tensorloom.llm.token_counts import TokenCache, tokenizer_version

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain(name):
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: len(pieces.encode(t))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


def expected(frame, name, limit=512):
    count = plain(name)
    return sorted((-1 if i is None else i, len((t or "").encode()), count(t or ""), count(t or "") > limit) for i, t, *_ in frame)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def test_query_counts_every_row(spark, folder, frame):
    assert rows(QUERIES["op11_token_counts"](spark, folder)) == expected(frame, "byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, folder, frame, tmp_path, name):
    got = token_counts.token_counts(spark.read.parquet(f"{folder}/documents.parquet"), str(tmp_path / "cache"), tokenizer=public_tokenizers.path(name), limit=10)
    assert rows(got) == expected(frame, name, 10)


def test_only_distinct_misses_are_encoded(spark, one_text, tmp_path):
    cache = str(tmp_path / "cache")
    store, version = TokenCache(spark, cache), tokenizer_version(BPE)
    first = token_counts.token_counts(one_text("a b", "a b", None, "c"), cache, tokenizer=BPE)
    assert sorted(r.n_tokens for r in first.collect()) == [0, 1, 2, 2]
    assert store.read(version).count() == 3 and len(store.batches(version)) == 1
    token_counts.token_counts(one_text("a b", "d e f", "c"), cache, tokenizer=BPE).collect()
    assert store.read(version).count() == 4 and len(store.batches(version)) == 2


def test_stored_counts_are_taken_and_versions_kept_apart(spark, one_text, tmp_path):
    cache, docs = str(tmp_path / "cache"), one_text("a b")
    digest = docs.select(token_counts.content_digest(F.col("text")).alias("digest"))
    TokenCache(spark, cache).append(digest.withColumn("n_tokens", F.lit(77).cast("long")), tokenizer_version(BPE))
    assert token_counts.token_counts(docs, cache, tokenizer=BPE).first().n_tokens == 77
    assert token_counts.token_counts(docs, cache, tokenizer=public_tokenizers.path("word_bpe_49k.json")).first().n_tokens == 2


def test_double_entries_and_compaction(spark, one_text, tmp_path):
    cache = str(tmp_path / "cache")
    store, version = TokenCache(spark, cache), tokenizer_version(BPE)
    counts = spark.createDataFrame([(bytes(32), 5)], token_counts.COUNTS)
    store.append(counts, version)
    store.append(counts, version)
    assert store.find(counts, version).collect() == [(bytearray(32), 5)]
    store.compact(version)
    assert store.read(version).count() == 1 and len(store.batches(version)) == 1


def test_normal_form_shares_counts(spark, one_text, tmp_path):
    cache = str(tmp_path / "cache")
    lower = {"tokenizer": public_tokenizers.path("word_bpe_49k.json"), "normalise": F.lower}
    got = token_counts.token_counts(one_text("Hello World", "hello world"), cache, **lower)
    assert {r.n_tokens for r in got.collect()} == {2}
    assert TokenCache(spark, cache).read(tokenizer_version(lower["tokenizer"])).count() == 1
