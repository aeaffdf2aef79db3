"""Token counts by a digest cache.

A text's count depends on its content and on the tokenizer alone, so counts are kept
by the digest of the content, below the digest of the tokenizer's version. A table is
joined to the stored counts by digest; of the contents that are not there one row each
is encoded, and their counts are appended to the cache. A content that stands in a
third of all rows is encoded once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import few, numbered, pick, stored, table, trimmed, whole_text
from tensorloom.llm.packing import Tokens

COUNTS = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of what decides a tokenizer's counts: its file, and the library with its version."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def counter(path: str, ranks: str | None = None) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, without special tokens added, truncation or padding.

    ``.model`` is read by sentencepiece, all else by tokenizers. ``ranks`` is the same
    byte-level vocabulary in rank form, which is encoded faster.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    if ranks:
        tokens = Tokens(path, ranks)
        return lambda texts: [len(tokens(x)) // 4 for x in texts]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(whole.encode(x, add_special_tokens=False)) for x in texts]


class TokenCache:
    """Counts by content digest in Parquet files: a folder a tokenizer version, a folder a batch.

    Batches are only ever added, and each row is a fact, so writers need no lock: two of
    them may store a digest twice, which readers merge, and a batch that was cut short
    holds true counts. ``compact`` merges batches of a version and deletes them then.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}")

    def _files(self, version: str):
        return self._folder(version).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, version: str) -> list[str]:
        """Folders of a version's batches; there is one for each append since it was compacted."""
        fs, folder = self._files(version), self._folder(version)
        return sorted(str(x.getPath()) for x in fs.listStatus(folder)) if fs.exists(folder) else []

    def read(self, version: str) -> DataFrame:
        """``digest, n_tokens`` as stored; a digest may come twice, with the same count."""
        found = self.batches(version)
        return self.spark.read.schema(COUNTS).parquet(*found) if found else self.spark.createDataFrame([], COUNTS)

    def find(self, digests: DataFrame, version: str) -> DataFrame:
        """Counts of those of ``digests`` that are stored, once each."""
        return self.read(version).join(digests.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> DataFrame:
        """Store ``digest, n_tokens`` as a new batch, which is returned as it was written."""
        path = f"{self.path}/version={version}/batch={uuid.uuid4().hex}"
        counts.select("digest", "n_tokens").write.parquet(path)
        return self.spark.read.schema(COUNTS).parquet(path)

    def compact(self, version: str) -> None:
        """Merge the batches that exist now. Readers in between see some counts twice, which changes nothing."""
        old, fs = self.batches(version), self._files(version)
        if len(old) > 1:
            self.append(self.spark.read.schema(COUNTS).parquet(*old).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), version)
            for path in old:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def token_counts(
    df: DataFrame, cache: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str, ranks: str | None = None, limit: int = 512, normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit, digest``.

    ``cache`` is the folder of a ``TokenCache``; it may be empty or not exist yet.
    ``normalise`` may map texts to a form that all texts of equal counts share, such as
    the tokenizer's own normal form; it must not change any count, and none is applied
    by default, as byte-level vocabularies tell all texts apart. ``n_bytes`` is that
    of the text as it stands.

    Null text counts as empty: no bytes and no tokens. Special strings in texts are
    read as the library does by default. A null id is passed on; repeated rows are
    returned one by one. Texts are encoded whole, however long. An empty table gives no
    rows; columns not named are not read.
    """
    tokenizer, ranks, version = str(tokenizer), ranks and str(ranks), tokenizer_version(str(tokenizer))
    store = TokenCache(df.sparkSession, cache)
    text = whole_text("text_")
    src = numbered(pick(df, doc_id=id_col, text_=text_col), "row")
    content = normalise(text) if normalise else text
    light = table(src.select("row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(content).alias("digest")), "content-digests")
    distinct = stored(light.groupBy("digest").agg(F.min("row").alias("row")))
    known = stored(store.find(few(distinct), version))
    misses = stored(distinct.join(few(known), "digest", "left_anti"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    texts = src.select("row", content.alias("content")).join(few(misses), "row").select("digest", "content")
    fresh = store.append(texts.mapInArrow(trimmed(encode), COUNTS), version)
    counts = known.unionByName(fresh)
    return light.join(few(counts), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
