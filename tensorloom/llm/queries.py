"""The registered queries of the training-data operators, at production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import conversations, langid, licenses, line_dedup, lsm_dedup, merkle, mixing, packing, pst, quality, simhash, suffix_dedup, token_counts
from tensorloom.llm.common import documents, numbered, remove_at_exit, shared_dir


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _in_fold(n: int, fold: int) -> Column:
    """Whether a document belongs to a fold by the checksum of its id; one without an id belongs to none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == fold, F.lit(False))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), _in_fold(4, 2)
    vocabulary = str(public_tokenizers.path("piece_bpe_32k.model"))
    langs, logs = langid.train(docs.where(~held_out), model=vocabulary)
    return langid.predict(docs, langs, logs, model=vocabulary).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), _in_fold(10, 0)
    scored = pst.score(docs, ~held_out)
    return scored.select("doc_id", F.col("fold").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsm_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that is empty before each run, so all distinct texts are encoded."""
    path = public_tokenizers.path
    cache = f"{shared_dir(spark)}/tensorloom/token-cache-{uuid.uuid4().hex}"
    remove_at_exit(spark, cache)
    return token_counts.token_counts(documents(spark, sf_dir), cache, tokenizer=path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken")).drop("digest")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("in_doc_id").cast("string")) % 7 == 0
    claim = merkle.leaf(F.col("in_doc_id"), F.col("in_source"), F.col("in_lang"), F.try_add(F.col("in_n_chars"), F.lit(1)), F.col("in_text"))
    found = merkle.manifest(documents(spark, sf_dir), extra={"claimed": F.when(tampered, claim)})
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows by ``crc32("conv_id:turn") % 20``: dropped, emptied, without ``.!?``, twice, or of role user; nulls in the checksum, role and text are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = numbered(conversations.select("conv_id", "turn", "role", "text")).withColumn("c", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20)
    text = F.when(F.col("c") == 1, F.lit("")).when(F.col("c") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("c") == 4, F.lit("user")).otherwise(spaced("role"))
    copies = F.explode(F.when(F.col("c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.where("c <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "row", copies)
    return rows.withColumn("row", F.col("row") * 2 + F.col("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    summary, turns = conversations.repair(damaged(given), row_col="row")
    ids = given.select("conv_id", conversations.conversation_key(F.col("conv_id")).alias("g")).distinct()
    found = ids.join(summary, "g", "left").join(conversations.turns_digest(turns), "g", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _crc32_sql(text: str) -> str:
    """DuckDB has no crc32: one step a bit, over the characters of an ASCII string."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    return f"sha256({' || '.join(part.format(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: DuckDB: levels by a recursive query, siblings by joins, and the fold over lists.
OP12_ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS altered, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '1')")} % 7 = 0 AND doc_id IS NOT NULL AS tampered FROM documents),
l AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS k, pos, leaf AS h, n FROM l UNION ALL SELECT g, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, k, pos // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, pos, h, n FROM s UNION ALL SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY k, pos // 2),
e AS (
  SELECT l.rid, 0 AS tree, v.k, CASE WHEN x.h IS NULL THEN '-' WHEN (l.pos >> v.k) & 1 = 1 THEN 'L' || x.h ELSE 'R' || x.h END AS entry
  FROM l JOIN (SELECT DISTINCT g, k FROM t WHERE n > 1) v USING (g) LEFT JOIN t x ON x.g = l.g AND x.k = v.k AND x.pos = xor(l.pos >> v.k, 1)
  UNION ALL
  SELECT l.rid, 1, v.k, CASE WHEN x.h IS NULL THEN '-' WHEN (s.pos >> v.k) & 1 = 1 THEN 'L' || x.h ELSE 'R' || x.h END
  FROM l JOIN s USING (g) CROSS JOIN (SELECT DISTINCT k FROM u WHERE n > 1) v LEFT JOIN u x ON x.k = v.k AND x.pos = xor(s.pos >> v.k, 1)),
p AS (SELECT rid, list(entry ORDER BY tree, k) AS path FROM e GROUP BY rid),
f AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: substr(x, 2)), ''), '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN tampered THEN altered ELSE leaf END], coalesce(path, [])), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN substr(x, 2) || a WHEN x[1] = 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root
  FROM l JOIN s USING (g) LEFT JOIN p USING (rid))
SELECT *, folded_root = root AS verified FROM f
"""

_SPACED = {c: f"coalesce(CAST({c} AS VARCHAR), ' ')" for c in ("conv_id", "turn", "role", "text")}

#: DuckDB: costs to the end by a recursive query from each conversation's last row, then the least letter step by step.
OP13_ORACLE = rf"""
WITH RECURSIVE o AS (
  SELECT coalesce('=' || conv_id, '') AS g, turn, {_SPACED['role']} AS role, {_SPACED['text']} AS text, {_crc32_sql(f"{_SPACED['conv_id']} || ':' || {_SPACED['turn']}")} % 20 AS c FROM conversations),
d AS (
  SELECT g, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, (SELECT unnest([1, 2]) AS copy) WHERE c <> 0 AND (copy = 1 OR c = 3)),
w AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, rtrim(text, e' \t\n\x0b\x0c\r') AS bare FROM d),
r AS (
  SELECT *, role[1] AS x, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE '' END AS fault FROM w),
m AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e, CASE WHEN x = 's' THEN 0 ELSE 1000000000 END AS ks, CASE WHEN x = 'u' THEN 0 ELSE 1 END AS ku, CASE WHEN x = 'a' THEN 0 ELSE 1 END AS ka FROM r),
b AS (
  SELECT DISTINCT g, n AS i, 0::BIGINT AS b0, 10::BIGINT AS b1, 5::BIGINT AS b2, 0::BIGINT AS b3 FROM m
  UNION ALL
  SELECT g, i, least(y0, 5 + y2, 10 + y3), least(y1, 5 + y2, 10 + y3), least(y2, 5 + y3), least(y3, 5 + y2)
  FROM (SELECT m.g, m.pos AS i, least(2 + b0, e + ks + b1, e + ku + b2) AS y0, least(2 + b1, e + ku + b2) AS y1, least(2 + b2, e + ka + b3) AS y2, least(2 + b3, e + ku + b2) AS y3 FROM b JOIN m ON m.g = b.g AND m.pos = b.i - 1)),
c AS (SELECT g, i, [b0, b1, b2, b3] AS b FROM b),
z AS (
  SELECT DISTINCT g, 0::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS out, false AS done FROM m
  UNION ALL
  SELECT g, CASE WHEN letter IN ('', 'I') THEN i ELSE i + 1 END, CASE letter WHEN 'I' THEN turned WHEN 'K' THEN kept WHEN 'R' THEN turned ELSE s END, audit || letter,
         CASE WHEN letter IN ('', 'D') THEN out ELSE list_append(out, CASE WHEN letter = 'K' THEN role ELSE CASE turned WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END, letter = ''
  FROM (
    SELECT z.*, m.role, m.text, CASE WHEN s = 2 THEN 3 ELSE 2 END AS turned, CASE WHEN x = 's' THEN 1 WHEN x = 'u' THEN 2 ELSE 3 END AS kept,
           CASE WHEN m.g IS NULL AND s IN (0, 3) THEN '' WHEN 2 + after.b[s + 1] = here.b[s + 1] THEN 'D' WHEN 5 + here.b[turned + 1] = here.b[s + 1] THEN 'I'
                WHEN (x = 's' AND s = 0 OR x = 'u' AND s <> 2 OR x = 'a' AND s = 2) AND e + after.b[kept + 1] = here.b[s + 1] THEN 'K' ELSE 'R' END AS letter
    FROM z JOIN c here ON here.g = z.g AND here.i = z.i LEFT JOIN c after ON after.g = z.g AND after.i = z.i + 1 LEFT JOIN m ON m.g = z.g AND m.pos = z.i WHERE NOT done)),
k AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(x) OVER (PARTITION BY g ORDER BY pos) AS before FROM r) GROUP BY g)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS g FROM conversations) ids LEFT JOIN k USING (g) LEFT JOIN (SELECT g, b0 FROM b WHERE i = 0) USING (g) LEFT JOIN (SELECT g, audit, out FROM z WHERE done) USING (g)
"""

QUERIES = {f.__name__: f for f in (op1_mixing, op2_licenses, op3_quality, op4_suffix_dedup, op5_langid, op6_lm_score, op7_line_dedup, op8_packing, op9_exact_dedup, op10_simhash, op11_token_counts, op12_merkle, op13_conversations)}
ORACLES = {"op1_mixing": mixing.ORACLE, "op2_licenses": licenses.ORACLE, "op3_quality": quality.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op9_exact_dedup": lsm_dedup.ORACLE, "op12_merkle": OP12_ORACLE, "op13_conversations": OP13_ORACLE}
