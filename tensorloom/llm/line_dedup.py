"""Line deduplication by winnowing.

Of each window of consecutive line hashes the minimum is selected, the rightmost of
equal ones, so any run of a window's length that two places share gives both the
same fingerprint. Only selected places become rows, with the few lines around them. Places
of equal fingerprints meet, and the lines left and right of them are compared: each
window that a fingerprint is the minimum of is matched with the first place of its lines.
Matches with one source row and offset that follow each other are one match, extended
both ways as far as the lines agree; such later runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, let, pick, table, whole_text


def lines_of(text: Column) -> Column:
    """The lines with at least one word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_deleted, n_runs, kept_text``.

    Lines are those with a word, compared as they are. A line is deleted if it lies in
    ``window`` consecutive lines that also stand at an earlier place: places are
    ordered by id (null last), then row, then line. ``n_runs`` counts maximal runs of
    deleted lines; ``kept_text`` has the other lines, joined by newlines.

    Null and empty texts have no lines; texts of fewer than ``window`` lines are kept
    whole. Of repeated rows the first stays. A run that overlaps its own repetition
    keeps its first line. An empty table gives no rows; columns not named are not read.
    """
    w = window
    src = pick(df, doc_id=id_col, text_=text_col)
    rows = table(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text("text_").alias("text")), "lines")
    hashed = rows.select("row", "doc_id", F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= w)

    def prints(h: Column) -> Column:
        """Each selected place once: its hash, the first window that it is the minimum of, how
        many windows these are (they follow each other), and the lines they span, left and right of it."""
        ordered = F.transform(h, lambda x, i: F.struct(x.alias("h"), (-i).alias("back")))
        least = lambda o, i: F.array_min(F.slice(o, i + 1, w))
        minima = let(ordered, lambda o: F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: least(o, i)))

        def selected(m: Column) -> Column:
            at = lambda k: F.get(m, k)["back"]
            follow = lambda i: sum((F.when(F.coalesce(at(i + k) == at(i), F.lit(False)), 1).otherwise(0) for k in range(1, w)), F.lit(1))
            one = F.transform(m, lambda x, i: F.struct(x["h"].alias("print"), i.alias("begin"), follow(i).alias("windows"), ((i == 0) | (at(i - 1) != x["back"])).alias("own")))
            return F.transform(F.filter(one, lambda x: x["own"]), lambda x: F.struct(x["print"].alias("print"), x["begin"].alias("begin"), x["windows"].alias("windows"), F.slice(h, x["begin"] + 1, x["windows"] + (w - 1)).alias("around")))

        return let(minima, selected)

    # one row a fingerprint; one that stands at a single place has no match
    places = hashed.select("row", "doc_id", F.explode_outer(let(F.col("h"), prints)).alias("x")).select("row", "doc_id", "x.*")
    repeated = places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    # where equal fingerprints meet, the lines around them are compared, window by window
    met = places.join(repeated, "print").select("row", "doc_id", "begin", "around", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"))
    candidates = met.select("row", "doc_id", (F.col("begin") + F.col("k")).alias("at"), F.slice("around", F.col("k") + 1, w).alias("run"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row").alias("row"), F.col("at").alias("at"))
    first = candidates.groupBy("run").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first")
    seeds = candidates.join(first, "run").where(order > F.col("first")).select("row", "at", F.col("first.row").alias("source"), (F.col("at") - F.col("first.at")).alias("offset"))
    # seeds side by side on one diagonal extend each other
    diagonal = Window.partitionBy("row", "source", "offset").orderBy("at")
    ranked = seeds.repartition("row").withColumn("side", F.col("at") - F.row_number().over(diagonal))
    runs_ = ranked.groupBy("row", "source", "offset", "side").agg(F.min("at").alias("begin"), (F.max("at") + (w - 1)).alias("last"))
    later = runs_.groupBy("row").agg(F.collect_list(F.struct("begin", "last")).alias("runs"))
    joined = rows.join(later, "row", "left").select("doc_id", lines_of(F.col("text")).alias("lines"), "runs")
    gone = F.when(F.col("runs").isNull(), F.array().cast("array<int>")).otherwise(F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(s["begin"], s["last"])))))
    marked = joined.select("doc_id", "lines", gone.alias("gone"))
    n = F.size("lines")
    left = F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    runs = F.size("gone") - F.size(F.array_intersect("gone", F.transform("gone", lambda i: i + 1)))
    return marked.select("doc_id", n.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), runs.cast("long").alias("n_runs"), F.array_join(kept, "\n").alias("kept_text"))


#: DuckDB: windows as rows of a table; all but the first of equal ones delete their lines.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS w FROM documents),
x AS (SELECT k, doc_id, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
y AS (SELECT k, s, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, k, s) AS n FROM x),
z AS (SELECT DISTINCT k, unnest([s, s + 1, s + 2]) AS i FROM y WHERE n > 1),
r AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) IS DISTINCT FROM i - 1 AS fresh FROM z),
g AS (SELECT k, count(*) AS n_deleted, count(*) FILTER (fresh) AS n_runs, list(i) AS gone FROM r GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""
