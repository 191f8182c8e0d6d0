import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


def corpus_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, ties, copies and shared passages."""
    rnd = random.Random(11)
    passage, lines = prose(rnd, 60), "\n".join(prose(rnd, 8) for _ in range(5))
    rows = [(i, prose(rnd, rnd.randrange(1, 200)), "en", f"src{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0", 0) for i in range(12)]
    rows += [(120 + i, prose(rnd, 20) + " " + passage + " " + prose(rnd, 15), "en", "src0", 0) for i in range(8)]
    rows += [(140 + i, prose(rnd, 5) + "\n" + lines + "\n" + prose(rnd, 5), "en", "src1", 0) for i in range(6)]
    rows += [(160, None, None, None, None), (161, "", "en", "src0", 0), (162, "   \t\n ", "en", None, 0), (163, "one", "en", "src9", 0)]
    rows += [(164, passage * 40, "en", "src2", 0), (165, "a" * 5000, "en", "src2", 0), (166, "ab" * 3000, "en", "src2", 0), (167, "é ü  \U0001f600 " * 30, "fr", "src3", 0)]
    rows += [(168, "THE OF and\ttwo  words", "en", "src3", 0), (169, "the of AND two\nwords", "en", "src3", 0)]
    rows += [(170 + i, rows[5][1].replace("the", "THE", i), "en", "src0", 0) for i in range(5)]
    rnd.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "fp th doc kh size target taken rank block shard spans digest n_tokens ids score keep_id kept text_sha256 source_size words left name pos".split()
    return docs.withColumns({n: F.lit(1) for n in names})
