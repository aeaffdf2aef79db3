"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. Sizes are summed by source and leading hash
bits; the running sum of such a histogram shows in which bucket a source's
budget ends, and only the rows of that bucket are summed again by their next
bits. After five levels the threshold is exact to one hash value, and documents
are taken by comparing their hash with their source's threshold: no sort, no
rank, no row ever gathered by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, few, pick, stored, whole_text

HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")).cast("long")


def unit_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on a row's id and text alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeat: int) -> DataFrame:
    """``source, source_size`` -> with ``target``: ``share`` of all sizes by weight,
    none above ``repeat`` times its source, what is above shared again by weight.

    With sources ordered by ceiling / weight, those below some level take their
    ceiling and all others weight x level; the level follows from running sums.
    One row a source takes part, whatever the number of documents.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ceiling", F.col("source_size") * F.lit(float(repeat)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level_here", left / heavy)
    level = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(everything)["level_here"]
    w = w.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("weight") * F.col("level")))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a source with its size, target, whole ``rounds`` and the hash ``cut``.

    Documents below ``cut`` are taken once more than ``rounds``; those at ``cut``
    too if ``at_cut``. That stops within half a document of the target.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    bounds = goal.select(F.col("source").alias("s_"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    rows, levels = sized.select("source", "h", "size"), HASH_BITS // LEVEL_BITS
    for k in range(levels):
        shift = HASH_BITS - LEVEL_BITS * (k + 1)
        if k:  # only the rows of each source's boundary bucket are summed again
            rows = rows.join(few(bounds.select("s_", "prefix")), F.col("source").eqNullSafe(F.col("s_")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")), "left_semi")
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("here"))
        run = sums.withColumn("through", F.sum("here").over(Window.partitionBy("source").orderBy("bucket")))
        over = run.join(bounds.select("s_", "rest", "below"), F.col("source").eqNullSafe(F.col("s_"))).withColumn("through", F.col("through") + F.col("below"))
        first = F.min(F.when(F.col("through") > F.col("rest"), F.struct("bucket", "here", "through")))
        bounds = stored(over.groupBy("s_", "rest").agg(first.alias("b")).where("b is not null").select("s_", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.through") - F.col("b.here")).alias("below"), F.col("b.through").alias("through")))
    cut = bounds.select("s_", F.col("prefix").alias("cut"), (F.col("below") + F.col("through") <= 2 * F.col("rest")).alias("at_cut"))
    return goal.join(cut, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_", "rest")


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeat: int = 2, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, copies, taken``
    and the columns named in ``keep``, prefixed with ``in_``.

    ``weights`` go to the sources in code-point order, null last, and repeat.
    ``copies`` is how often the mix takes the document (0 to ``repeat``), and
    ``taken`` is ``copies`` x ``size``.

    Null text counts as empty (size 0); null is a source of its own; a null id is
    hashed as the empty string. Rows equal in id and text share a hash and are
    taken or left together; other ties in size do not matter. A source without
    words has target 0. An empty table gives no rows. Columns not named are not
    read, whatever they are called.
    """
    src = pick(df, doc_id=id_col, text_=text_col, source=source_col, **{f"in_{c}": c for c in keep})
    text = whole_text("text_")
    kept = [f"in_{c}" for c in keep]
    sized = src.select("doc_id", "source", n_words(text).alias("size"), unit_hash(F.col("doc_id"), text).alias("h"), *kept)
    small = stored(sized.drop(*kept))  # 40 bytes a document; read once for each level
    targets = stored(source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat))
    cuts = stored(thresholds(small, targets)).withColumnRenamed("source", "s_")
    extra = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("at_cut"))
    # where a source's target is all it may give, what lies below the cut has no words and is not taken again
    copies = F.least(F.col("rounds") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(repeat))
    rows = sized if keep else small
    return rows.join(few(cuts), F.col("source").eqNullSafe(F.col("s_")), "left").select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *kept
    )


#: DuckDB: the same mix by sorting hashes instead of refining histograms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS ceiling FROM s),
r AS (SELECT *, ceiling / weight AS ratio FROM w),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(ceiling) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level_here
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN v IS NULL THEN ceiling ELSE least(ceiling, weight * v) END AS target
  FROM (SELECT *, first_value(level_here) OVER (ORDER BY (level_here <= ratio) DESC, ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
               bool_or(level_here <= ratio) OVER () AS found, CASE WHEN found THEN f END AS v FROM l)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.rounds, g.target - g.rounds * g.source_size AS rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS BIGINT) AS through, CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS ties
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (rounds + CASE WHEN 2 * through - ties <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
