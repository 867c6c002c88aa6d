import pytest
from pyspark.sql import functions as F

#: Long texts, blanks, ties and letters beyond ASCII.
TEXTS = ["", " \n\t ", "one", "The cat sat on the mat and then the dog came in to sit beside the cat on the mat.", "Ünïcode ÉTÉ — 日本語 😀 <|endoftext|>  two  spaces \n", "a" * 5000, "word " * 3000, "under the MIT License, and CC BY-NC"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null texts, repeated rows and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(20, None), (None, TEXTS[3]), (None, None), (3, TEXTS[3]), (3, TEXTS[3]), (21, TEXTS[3])]
    names = "fp key n gram seeds root words pos rep start score held_out kept lang_pred part payload print votes chain cuts y x w l failed component_id".split()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
