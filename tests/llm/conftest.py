import pytest


@pytest.fixture()
def scratch(spark):
    from amberline.llm.scratch import Scratch

    return Scratch(spark, "test")


#: Texts with copies, near copies, shared passages, odd characters, and rows that are easy to get wrong.
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BASE = " ".join(f"word{i} thing{i % 7}" for i in range(80))
TEXTS = [
    BASE,
    BASE,
    BASE.replace("word11 ", "other "),
    "intro one\n" + PASSAGE + "\nend",
    "quite different start\n" + PASSAGE + " tail",
    None,
    "",
    "   \n\t ",
    "one",
    "One two",
    "one TWO",
    "éà ñ 日本語 \U0001f600 ß",
    "a" * 300,
    "b " * 400,
    BASE[:400],
    "line that repeats within the text\nline that repeats within the text\n\nline that repeats within the texts",
    "line that repeats within the text",
]


@pytest.fixture()
def docs(spark):
    """The texts with ids, a row twice over, a row without id, and columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("key", "v", "n", "spans", "line", "pos", "score", "component_id", "bucket")])


@pytest.fixture()
def empty(docs):
    return docs.limit(0)
