"""Queries read whole documents and whole tables, however long."""

import pytest
from pyspark.sql import functions as F

from veldspar.operators import funding
from veldspar.plans import funding as funding_plans
from veldspar.plans import lab, manuscripts


def test_every_line_of_a_document_is_a_paragraph(spark, tmp_path):
    long = {1: 39, 2: 41, 3: 1500, 19: 2500}
    rows = [(d, "\n".join(f"line {k} of it" for k in range(n))) for d, n in long.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = manuscripts.paragraphs(spark, str(tmp_path))
    kind = F.when(F.col("section").isin("figure_legends", "references"), F.col("section")).otherwise("lines")
    at = {(r.doc_id, r.kind): r for r in got.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("idx").alias("places"), F.min("idx").alias("low"), F.max("idx").alias("high")).collect()}
    for d, n in long.items():
        assert (at[str(d), "lines"].n, at[str(d), "lines"].low, at[str(d), "lines"].high) == (n, 0, n - 1)
        parts = [at[str(d), k] for k in ("lines", "figure_legends", "references") if (str(d), k) in at]
        assert all(p.n == p.places for p in parts) and all(a.high < b.low for a, b in zip(parts, parts[1:]))
    assert (at["2", "figure_legends"].low, at["2", "references"].low) == (1001, 2001)


def test_checks_see_what_stands_after_line_40(spark, tmp_path):
    spark.createDataFrame([(4, "\n".join(["line"] * 60))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cited = manuscripts.m.callouts(manuscripts.paragraphs(spark, str(tmp_path)))
    assert cited.agg(F.max("idx")).first()[0] >= 55


def test_every_order_line_is_an_order(spark, sf):
    got = lab.orders(spark, sf).agg(F.count("*"), F.countDistinct("id"), F.countDistinct("seq")).first()
    assert set(got) == {spark.read.parquet(f"{sf}/lineitem.parquet").count()}


@pytest.mark.parametrize("block", [1, 2, 100])
def test_lists_in_blocks_stand_beside_every_row(spark, block):
    rows, listed = spark.range(5).withColumnRenamed("id", "a"), spark.range(7).withColumnRenamed("id", "b")
    got = sorted((r.a, r.b) for r in funding.beside(rows, listed, block).collect())
    assert got == [(a, b) for a in range(5) for b in range(7)]


def test_calls_in_blocks_give_the_same_verdicts(spark, monkeypatch, sf):
    run = funding_plans.QUERIES["fel11_match"][0]
    want = sorted(map(tuple, run(spark, sf).collect()), key=str)
    monkeypatch.setattr(funding.beside, "__defaults__", (2,))
    assert want and sorted(map(tuple, run(spark, sf).collect()), key=str) == want


def test_every_row_of_rules_is_applied(spark):
    docs = spark.sql("SELECT 1 AS doc, 300 AS words, 4 AS pages, 2.0D AS min_margin, array(named_struct('pt', 11D, 'chars', 9L)) AS sizes")
    rules = spark.createDataFrame([("cv", 200, None, None, None), ("case", 500, 5, None, None)], "name string, max_words int, max_pages int, min_margin_cm double, min_pt double")
    got = sorted(map(tuple, funding.measured(docs, rules).collect()))
    assert got == [(1, "case", "pages", "ok"), (1, "case", "words", "ok"), (1, "cv", "words", "fail")]
