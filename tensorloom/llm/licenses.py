"""Licence scans by diagonal voting.

Every 2-word gram of every document is hashed and joined to the places of the
same gram in a fixed set of licence templates. A hit at document word ``p`` and
template word ``o`` votes for the diagonal ``p - o``: the place where the whole
template would start. Votes are gathered by document, template and diagonal;
neighbouring diagonals, which an inserted or a missing word tears apart, are
merged; and spans with enough votes are verified word after word: the merged span, or
the place of its best diagonal alone, must become the template with few edits.

The template side is a few hundred rows fixed in this file, so broadcasting it
is bounded whatever the table's size. Only hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import pick, whole_text


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    exact: bool


#: Phrases that must stand word for word.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Clauses of public licences and of the notices that name them, as fixed values; they are
#: found although words are added, changed or missing.
SENTENCES = (
    ("agpl", "gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)

#: Words that are no evidence by themselves: a gram of two of them casts no vote.
COMMON = frozenset("a and any are as at be by for from in is it may not of on or that the this to under use with you".split())

#: Diagonals this close belong to one alignment.
NEIGHBOUR = 3
#: Part of a sentence's votes that a span must hold, and edits a span may need for each of
#: the sentence's characters to become the sentence.
MIN_VOTES, MAX_EDITS = 0.6, 0.3
#: Words by which a merged span may reach beyond its best diagonal on either side.
MARGIN = 2 * NEIGHBOUR

WORD_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[Template]:
    return [Template(a, tuple(b.split()), True) for a, b in PHRASES] + [Template(a, tuple(b.split()), False) for a, b in SENTENCES]


def grams(template: Template) -> list[int]:
    """Offsets of the template's voting grams."""
    w = template.words
    return [o for o in range(len(w) - 1) if template.exact or not {w[o], w[o + 1]} <= COMMON]


#: Votes of a template, which are kept as bits of one long.
VOTES = 62


def clauses(template: Template) -> list[Template]:
    """A template of any length as clauses that vote for themselves, of about equal lengths.

    An exact one must stand as a whole, so it is not cut: beyond ``VOTES`` grams, and without
    any gram that votes, it is refused.
    """
    n = len(template.words)
    if template.exact and not 0 < len(grams(template)) <= VOTES or not grams(template):
        raise ValueError(f"{n} words cannot vote as one exact template" if template.exact else "a template needs two words that stand together and are not both common")
    parts = -(-n // VOTES)
    cut = [template._replace(words=template.words[k * n // parts : (k + 1) * n // parts]) for k in range(parts)]
    return [t for t in cut if grams(t)]


def words_of(text: Column) -> Column:
    """Words of letters, digits and everything beyond ASCII, with A-Z lower-cased.

    lower() alone would also make ASCII letters of the Kelvin sign and of the
    dotted capital I; both are replaced first.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.array_remove(F.split(F.lower(safe), WORD_SPLIT), "")


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[Template] = ()) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``.

    ``n_base`` counts the places of exact templates; ``first_word`` and
    ``last_word`` are their smallest and largest start. ``labels`` adds those of
    sentences with a verified span. ``score`` is the largest part of a template's
    votes that one alignment holds. ``spans``: (start, end, label), end exclusive,
    of all accepted spans.

    Null text counts as empty: no words, no labels (""), score 0. Equal rows give
    equal results, one row each. Overlapping places all count; ties between
    templates cannot occur, as all accepted labels are listed. An empty table
    gives no rows; columns not named are not read. Templates of ``extra`` may be whole
    licence texts: long ones are cut into clauses, each of which is found by itself.
    """
    spark = df.sparkSession
    every = templates() + [part for t in extra for part in clauses(t)]
    rows = [(-1, 0, None, None, "", "", 0, 1, False)]  # a row that each document hits once
    for k, t in enumerate(every):
        for bit, o in enumerate(grams(t)):
            rows.append((k, o, t.words[o], t.words[o + 1], t.label, " ".join(t.words), len(t.words), 1 << bit, t.exact))
    n_votes = {k: len(grams(t)) for k, t in enumerate(every)}
    seeds = spark.createDataFrame(rows, "t int, o int, a string, b string, label string, body string, len int, vote long, exact boolean")
    seeds = seeds.withColumn("gram", F.when(F.col("t") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b"))).drop("a", "b")

    src = pick(df, doc_id=id_col, text_=text_col)
    text = whole_text("text_")
    split = src.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    rolled = split.select(
        "doc_id", "text_hash", "words",
        F.concat(F.array(F.lit(0).cast("long")), F.slice(F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("words") - 1, F.lit(0)))).alias("grams"),
    )
    # the arrays are never empty; the outer form keeps the optimizer from computing them once more in a filter
    hits = rolled.select("doc_id", "text_hash", "words", F.posexplode_outer("grams").alias("pos", "gram")).join(F.broadcast(seeds), "gram")
    hits = hits.where(F.when(F.col("t") < 0, F.col("pos") == 0).otherwise(F.col("pos") > 0))
    start = F.when(F.col("t") < 0, F.lit(0)).otherwise(F.col("pos") - 1 - F.col("o"))
    # the words of the template's place, and for sentences a margin on either side
    margin = F.when(F.col("exact"), 0).otherwise(MARGIN)
    first = F.greatest(start - margin, F.lit(0))
    place = F.slice("words", first + 1, F.when(F.col("t") < 0, 0).otherwise(F.greatest(start + F.col("len") + margin - first, F.lit(0))))
    hits = hits.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "t", "label", "len", "exact", "body", start.alias("diagonal"),
        "vote", F.array_join(place, " ").alias("place"),
    )
    key = ["doc_id", "text_hash", "n_words"]
    votes = F.element_at(F.create_map(*[x for k, n in {-1: 1, **n_votes}.items() for x in (F.lit(k), F.lit(n))]), F.col("t"))
    diagonals = (
        hits.repartition(*key)  # the groupings and windows below all hold within a document
        .groupBy(*key, "t", "diagonal", "len", "label", "exact", "body")
        .agg(F.bit_or("vote").alias("votes"), F.first("place").alias("place"), F.count("*").alias("rows"))
    )
    by_diagonal = Window.partitionBy(*key, "t").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEIGHBOUR).cast("int"), F.lit(0))
    merged = (
        diagonals.withColumn("fresh", F.when(F.col("exact"), F.lit(1)).otherwise(fresh))
        .withColumn("band", F.sum("fresh").over(by_diagonal))
        .groupBy(*key, "t", "band", "len", "label", "exact", "body")
        .agg(
            F.bit_or("votes").alias("votes"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.max("rows").alias("rows"),
            F.max(F.struct(F.bit_count("votes").alias("n"), (-F.col("diagonal")).alias("at"), "place")).alias("best"),
        )
    )
    found = F.bit_count("votes") / votes
    best, words = -F.col("best.at"), F.split("best.place", " ")

    def edits(lo: Column, hi: Column) -> Column:
        """Edits between the template and the words from diagonal ``lo`` to the end of ``hi``."""
        begin, first = F.greatest(lo, F.lit(0)), F.greatest(best - MARGIN, F.lit(0))
        span = F.slice(words, begin - first + 1, F.greatest(hi + F.col("len") - begin, F.lit(0)))
        return F.levenshtein(F.regexp_replace(F.array_join(span, " "), r"[^\x00-\x7F]", "?"), F.col("body"))

    near = F.least(edits(best, best), edits(F.greatest("lo", best - MARGIN), F.least("hi", best + MARGIN)))
    accepted = F.when(F.col("exact"), F.col("best.place") == F.col("body")).otherwise(F.when(found >= MIN_VOTES, near <= MAX_EDITS * F.length("body")).otherwise(F.lit(False)))
    judged = merged.select(*key, "t", "label", "exact", "rows", "lo", F.greatest("lo", F.lit(0)).alias("begin"), (F.col("hi") + F.col("len")).alias("end"), F.when(F.col("t") >= 0, found).alias("found"), ((F.col("t") >= 0) & accepted).alias("ok"))
    base = F.col("ok") & F.col("exact")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = judged.groupBy(*key).agg(
        F.max(F.when(F.col("t") < 0, F.col("rows"))).alias("copies"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max("found"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("begin", F.least("end", F.col("n_words")).alias("end"), "label")))).alias("spans"),
    )
    # equal rows were counted together; each gets its own row again
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies", "text_hash")


def _oracle() -> str:
    every = templates()
    seeds = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {str(t.exact).lower()}, '{' '.join(t.words)}', {o}, '{t.words[o]} {t.words[o + 1]}', {len(grams(t))})" for k, t in enumerate(every) for o in grams(t))
    return rf"""
WITH s(t, label, len, exact, body, o, gram, n) AS (VALUES {seeds}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(lower(replace(replace(coalesce(text, ''), chr(8490), chr(233)), chr(304), chr(233))), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT k, p - 1 AS p, w[p] || ' ' || w[p + 1] AS gram FROM (SELECT k, w, unnest(range(1, len(w))) AS p FROM d)),
h AS (SELECT k, t, label, s.len, exact, body, n, p - o AS diagonal, count(DISTINCT o) AS votes, list(o) AS os FROM g JOIN s USING (gram) GROUP BY ALL),
b AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER v > {NEIGHBOUR} THEN 1 ELSE 0 END AS fresh FROM h WINDOW v AS (PARTITION BY k, t ORDER BY diagonal)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY k, t ORDER BY diagonal) AS band FROM b),
m AS (
  SELECT k, t, label, len, exact, body, n, band, len(list_distinct(flatten(list(os)))) AS votes, min(diagonal) AS lo, max(diagonal) AS hi, arg_max(diagonal, votes * 100000000 - diagonal) AS best
  FROM c GROUP BY ALL),
p AS (
  SELECT m.*, array_to_string(list_slice(d.w, greatest(best, 0) + 1, best + m.len), ' ') AS place,
         array_to_string(list_slice(d.w, greatest(lo, best - {MARGIN}, 0) + 1, least(hi, best + {MARGIN}) + m.len), ' ') AS span
  FROM m JOIN d USING (k)),
j AS (
  SELECT k, label, exact, lo, CAST(votes AS DOUBLE) / n AS found,
         CASE WHEN exact THEN place = body
              WHEN CAST(votes AS DOUBLE) / n >= {MIN_VOTES}
              THEN least(levenshtein(regexp_replace(place, '[^\x00-\x7F]', '?', 'g'), body), levenshtein(regexp_replace(span, '[^\x00-\x7F]', '?', 'g'), body)) <= {MAX_EDITS}::DOUBLE * length(body)
              ELSE false END AS ok
  FROM p),
r AS (
  SELECT k, count(*) FILTER (ok AND exact) AS n_base, min(lo) FILTER (ok AND exact) AS first_word, max(lo) FILTER (ok AND exact) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (ok AND exact)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ',') AS labels, max(found) AS score
  FROM j GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN r USING (k)
"""


ORACLE = _oracle()
