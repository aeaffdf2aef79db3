"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns
of ``documents``; columns of other names are left behind, whatever they are called.
Null and empty texts end at the quality rules, null ids and sources are carried along,
repeated rows count one by one until the exact duplicates go, and an empty table gives
no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import documents, few, numbered, stored, table
from tensorloom.llm.lsm_dedup import exact_dedup
from tensorloom.llm.mixing import mix_sources
from tensorloom.llm.packing import pack
from tensorloom.llm.quality import quality
from tensorloom.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without the lines that failed."""
    judged = quality(docs, keep=COLUMNS)
    cut = F.col("n_bad_lines") > 0
    changed = {
        "text": F.when(cut, F.col("cleaned_text")).otherwise(F.col("in_text")),
        "n_chars": F.when(cut, F.length("cleaned_text")).otherwise(F.col("in_n_chars")).cast(docs.schema["n_chars"].dataType),
    }
    row = F.struct("kept", *[changed.get(c, F.col(f"in_{c}")).alias(c) for c in COLUMNS])
    # a filter on "kept" would be moved below and work all rules out once more
    return judged.select(F.explode_outer(F.filter(F.array(row), lambda x: x["kept"])).alias("x")).where("x is not null").select(*[f"x.{c}" for c in COLUMNS])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    rows = numbered(docs.select(*COLUMNS))
    dropped = stored(exact_dedup(rows, row_col="row").where("not kept").select("row"))
    return rows.join(few(dropped), "row", "left_anti").select(*COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    rows = numbered(docs.select(*COLUMNS))
    dropped = stored(near_duplicates(rows, row_col="row").where("row <> root").select("row"))
    return rows.join(few(dropped), "row", "left_anti").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix_sources(docs, keep=COLUMNS).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col(f"in_{c}").alias(c) for c in COLUMNS])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicate_groups),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The last stages hash, sketch and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over ``documents``; stages in between are written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
