import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Extra columns with names that operators use inside.
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("block", StringType()), StructField("fp", StringType()), StructField("size", StringType()),
    StructField("key", StringType()), StructField("bucket", StringType()), StructField("copy", StringType()), StructField("row", StringType()),
])


def prose(seed: int, n: int) -> str:
    """Words from a small generator, as long as asked for."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("aeiourstlnmdé"[(x >> s) % 13] for s in range(4, 4 + 3 * (1 + x % 4), 3)))
    return " ".join(out)


def documents() -> list[tuple[int | None, str | None, str | None, str | None]]:
    shared = prose(900, 30)
    rows = [(i, prose(i, 20 + 7 * i), ["en", "fr", None][i % 3], f"s{i % 4}") for i in range(24)]
    rows += [(40 + i, f"{prose(60 + i, 15)}\n{shared}\n{prose(80 + i, 9)}", "en", "hot") for i in range(12)]  # a shared passage
    rows += [(70 + i, rows[5][1], "fr", "hot") for i in range(9)]  # exact copies
    rows += [(90, prose(3, 41).replace("a", "e", 1), "en", "s1")]  # a near copy of document 3
    rows += [(None, None, None, None), (None, prose(6, 62), None, None), (None, None, None, None)]
    rows += [(100, "", "en", None), (101, None, "en", "s1"), (102, " \t\n", "en", "s1"), (103, "12 34 !!", "en", "s2"), (104, "Ünï 字 🙂 <|endoftext|>\x1c a b", "fr", "s2")]
    rows += [(105, prose(7, 6000), "en", "s3"), (106, "x" * 30_000, "en", "s3"), (107, "one", "en", "s0"), (107, "one", "en", "s0"), (107, "one", "en", "s0"), (107, "other words", "en", "s0")]
    rows += [(110 + 10 * j + i, prose(30 + i, 400) + " more" * j, "en", "s0") for i in range(5) for j in (0, 1)]  # a few bits apart
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "b", "f", "z", None, "k", "c", "r") for r in rows], SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
