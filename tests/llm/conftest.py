"""A small table with every odd case, and DuckDB over the same rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

LICENSE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "thing", "ränge", "été", "house", "Garden", "water", "über", "x", "sur", "les", "with"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    shared = [line(12) for _ in range(5)]
    out = ["\n".join(line(rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(30)]
    out += ["\n".join([line(9), *shared, line(9)]), "\n".join([*shared[1:], line(5)]), "\n".join(shared[:2]), "\n".join(["same line here."] * 7)]
    out += [out[3], out[3] + " ", out[3].replace(" ", "\t"), "  " + out[3] + "\n\n"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    out += [long, long[:-20] + "end"]
    out += [None, None, "", " \t\n", "\x0b\x0c", "word", "two words", "### $$$ ***", "a" * 5000, "1 2 3", "ⓐ İK KIT ©", "  "]
    out += [LICENSE, LICENSE.replace("hereby", "now hereby"), "Licensed under the Apache License; CC BY, CC-BY. MIT license mit LICENSE", "GNU General\nPublic --- License " * 3, "apache"]
    out += ["home | about | news | contact | help | log in | more | terms " * 9, "!! WOW!! " * 60, line(80) + "\nLorem ipsum, all rights reserved.\n" + line(3), "<|endoftext|> as text  with   gaps \n  and ends "]
    return out


@pytest.fixture(scope="session")
def frame():
    """Rows of documents, without the columns that only clash."""
    found = texts()
    rows = [(k if k % 17 else None, t, ["en", "fr", "de", None][k % 4], [None, "a", "b", "é", "a", "a"][k % 6], len(t or "")) for k, t in enumerate(found)]
    return [*rows, rows[2], rows[2], rows[40]]  # and repeated ones


#: Names that operators use for columns of their own.
CLASHING = ("size", "taken", "row", "words", "h", "k1", "key", "copies", "kept", "id", "v")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame(frame, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def duck(folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return connection


@pytest.fixture(scope="session")
def one_text(spark):
    def make(*found):
        return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(found)], SCHEMA).withColumn("one", F.lit(1))

    return make
