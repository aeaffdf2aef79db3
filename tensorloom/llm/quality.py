"""Quality rules, line first: clean each text line by line, then judge what is left.

Every line is tested for punctuation, navigation and boilerplate. Failing lines
are removed, and a document is rejected if too large a part of its words went
with them. All of it is one projection over the table: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, let, pick, whole_text

WORD_SPLIT = f"[{SPACE}]+"

#: Lower-case phrases of page furniture; a line with one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "enable javascript",
    "lorem ipsum", "click here", "sign in", "log in to", "subscribe to our", "read more", "skip to content", "follow us on", "share on",
)

#: Words up to which a position is packed beside a window's hash.
PACKED = 1 << 23

#: Bullets and arrows of menus.
NAVIGATION = "[»›·•]"


def failing_line(line: Column) -> Column:
    """Whether a line with words breaks a rule.

    Punctuation: over a fifth as many of ``# * $ % & | < > { }`` or of ``!!`` as
    words, or no sentence end in a line of more than 100 words. Navigation: a
    list of links or menu entries (three or more bullets or arrows). Boilerplate:
    a phrase of page furniture. Words are counted as single spaces plus one.
    """
    length, words = F.length(line), F.size(F.split(line, " "))
    symbols = length - F.length(F.regexp_replace(line, "[#*$%&|<>{}]", ""))
    shouts = length - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    endless = (words > 100) & ~line.rlike("[.!?…。:;]")
    menu = length - F.length(F.regexp_replace(line, NAVIGATION, "")) >= 3
    links = F.size(F.split(line, "://")) > 3
    return (symbols * 5 > words) | (shouts * 5 > words) | endless | menu | links | let(F.lower(line), _any_phrase)


def _any_phrase(x: Column) -> Column:
    found = x.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        found = found | x.contains(phrase)
    return found


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice in ``words``.

    Windows are first paired by 40 bits of their hash, packed with the position
    into one long so that a primitive sort brings equal ones together; those that
    have a neighbour are compared as strings, so the count does not rest on hashes.
    Texts with more words than positions fit (``PACKED``) sort pairs instead.
    """
    n = F.size(words)
    at = F.lit(PACKED - 1).cast("long")

    def packed(w: Column) -> Column:
        grams = F.zip_with(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda h, c: F.xxhash64(h, c))
        return F.slice(grams, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def twins(sorted_: Column, same, value=lambda x: x) -> Column:
        """``value`` of the elements equal to the one before or after by ``same``; a primitive value, as distinct ones are then found by hashing."""
        pairs = F.zip_with(F.slice(sorted_, 1, F.greatest(F.size(sorted_) - 1, F.lit(0))), F.slice(sorted_, 2, F.greatest(F.size(sorted_) - 1, F.lit(0))), lambda a, b: F.when(same(a, b), F.array(value(a), value(b))))
        return F.array_distinct(F.flatten(F.array_compact(pairs)))

    def paired(w: Column) -> Column:
        keyed = F.sort_array(F.transform(packed(w), lambda h, i: h.bitwiseAND(F.bitwise_not(at)).bitwiseOR(i.cast("long"))))
        return let(keyed, lambda s: twins(s, lambda a, b: a.bitwiseOR(at) == b.bitwiseOR(at), lambda x: x.bitwiseAND(at).cast("int")))

    def paired_apart(w: Column) -> Column:
        keyed = F.sort_array(F.transform(packed(w), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(keyed, lambda s: twins(s, lambda a, b: a["h"] == b["h"], lambda x: x["i"]))

    def covered(w: Column) -> Column:
        maybe = F.when(F.size(w) <= PACKED, paired(w)).otherwise(paired_apart(w))
        named = let(maybe, lambda s: F.sort_array(F.transform(s, lambda p: F.struct(F.concat_ws(" ", F.slice(w, p + 1, 3)).alias("g"), p.alias("p")))))
        found = let(named, lambda s: F.sort_array(twins(s, lambda a, b: a["g"] == b["g"], lambda x: x["p"])))
        # each repeated window adds its three words, less what the next one covers again
        return let(found, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(words, covered))


def quality(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 30, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_bad_lines, lost_words, kept,
    cleaned_text`` and the columns named in ``keep``, prefixed with ``in_``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_pct``
    percent of them inside repeated 3-word windows. ``kept``: not ``base_failed``,
    and failing lines hold at most ``max_lost_pct`` percent of the words.

    Null text counts as empty: all counts 0, ``base_failed``, cleaned to "".
    Repeated rows are judged one by one; ids are only passed on. An empty table
    gives no rows; columns not named are not read.
    """
    src = pick(df, doc_id=id_col, text_=text_col, **{f"in_{c}": c for c in keep})
    kept = [f"in_{c}" for c in keep]
    text = whole_text("text_")
    split = src.select(
        "doc_id", *kept,
        F.array_remove(F.split(text, WORD_SPLIT), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    tested = split.select(
        "doc_id", *kept, "n_symbols", "words", "lines",
        F.transform("lines", lambda x: let(x, failing_line)).alias("bad"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    good = F.filter(F.zip_with("lines", "bad", lambda a, b: F.when(~b, a)), lambda x: x.isNotNull())
    counted = tested.select(
        "doc_id", *kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        F.array_join(good, "\n").alias("cleaned_text"),
        F.size(F.filter("bad", lambda x: x)).cast("long").alias("n_bad_lines"),
    )
    lost = F.when(F.col("n_bad_lines") == 0, F.lit(0)).otherwise(F.col("n_words") - F.size(F.array_remove(F.split("cleaned_text", WORD_SPLIT), ""))).cast("long")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return counted.withColumn("lost_words", lost).withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("lost_words") <= max_lost_pct * F.col("n_words")))


_FURNITURE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
#: DuckDB: the same rules; windows are counted as rows of a table.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
y AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM x),
z AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM y WHERE n > 1) GROUP BY k),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (
  SELECT k, line, length(line) - length(replace(line, ' ', '')) + 1 AS n,
         length(line) - length(regexp_replace(line, '[#*$%&|<>{{}}]', '', 'g')) AS symbols,
         length(line) - length(replace(line, '!!', '!')) AS shouts
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) FILTER (symbols * 5 > n OR shouts * 5 > n OR (n > 100 AND NOT regexp_matches(line, '[.!?…。:;]'))
           OR length(line) - length(regexp_replace(line, '{NAVIGATION}', '', 'g')) >= 3 OR len(string_split(line, '://')) > 3
           OR {_FURNITURE}), 0) AS lost
  FROM m GROUP BY k),
r AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN q USING (k) LEFT JOIN z USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= 30 * n_words AS kept FROM b
"""
