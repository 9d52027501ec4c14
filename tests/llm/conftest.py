import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bands string, __a bigint, row string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(12)]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 6}", len(t), "x", 1, "y") for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", f"s{i % 6}", 9, None, None, None) for i in range(8)]  # copies
    near = base[1].split()
    out += [(200 + i, " ".join([*near[: 20 + i], "zzz", *near[21 + i :]]), "en", "s1", 9, "", 0, "") for i in range(4)]
    out += [(300, None, None, None, None, None, None, None), (301, "", "en", "s1", 0, "", 0, ""), (302, "   \n\t ", "fr", None, 5, "", 0, ""), (303, "!!! ... 123", "en", "s2", 11, "", 0, "")]
    out += [(None, base[3].upper(), "en", "s3", 1, "", 0, ""), (304, "don't we'll  stop​ éü中文 ²½\r\n x", "en", "s3", 1, "", 0, "")]
    out += [(305, base[5], "en", "s5", 1, "", 0, "")] * 2  # a repeated row
    out += [(306, "a" * 3000 + " " + words(rng, 4000) + " " + "ab " * 500, "en", "s0", 1, "", 0, "")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
