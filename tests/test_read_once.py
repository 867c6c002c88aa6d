"""Texts are read and searched once, rules that compared pairs go by one sort, and the results stay."""

from pyspark.sql import functions as F

from veldspar.functions.text import matches
from veldspar.operators import citations, legends, manuscripts, species, spelling
from veldspar.plans import manuscripts as papers
from veldspar.plans import prose, references


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def paragraphs(spark, rows, section="results"):
    return spark.createDataFrame([(d, i, t, section, False) for d, i, t in rows], "doc_id string, idx int, text string, section string, is_heading boolean")


def test_a_run_of_all_checks_makes_no_paragraph_twice(spark, sf):
    p = papers.paragraphs(spark, sf)
    whole = manuscripts.run(p)
    assert "posexplode(split(coalesce(text" not in plan(whole)
    for name, check in manuscripts.CHECKS.items():
        for code, df in check(p).items():
            assert sorted(map(tuple, whole.where((F.col("check") == name) & (F.col("code") == code)).drop("check_rank").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr), code


def test_late_figures_are_found_without_pairs(spark):
    rows = [("a", 0, "see Fig. 3 and"), ("a", 1, "see Fig. 2 and"), ("a", 2, "then Figs. 1-3 here"), ("b", 0, "as Figs. 1-2 show"), ("b", 1, "in Fig. 3 too")]
    late = manuscripts.figure_issues(paragraphs(spark, rows))["citation_order"]
    assert sorted((r.doc_id, r.para_index, r.detail) for r in late.collect()) == [("a", 0, "figure main 3 before 1"), ("a", 1, "figure main 2 before 1")]
    assert "Join" not in plan(late)


def test_letters_of_a_legend_are_looked_for_once(spark):
    made = manuscripts.legend_panels(paragraphs(spark, [("a", 0, "Figure 1. Title (A) and (b), then (D)")], "figure_legends"))
    assert [r.panels for r in made.collect()] == [["A", "B"]]
    assert plan(made).count("regexp_extract_all") == 1


def test_a_pattern_runs_twice_over_a_text(spark):
    df = spark.createDataFrame([("a1bb22",)], "text string").select(matches(F.col("text"), "[0-9]+").alias("m"))
    assert [tuple(x) for x in df.first().m] == [(1, "1"), (4, "22")]
    assert plan(df.repartition(2)).count("regexp_extract_all") <= 1


def test_matches_are_placed_without_reading_the_paragraphs_again(spark):
    p = paragraphs(spark, [("a", 0, "one [Ab1,"), ("a", 1, ""), ("a", 2, "Cd2] two [Ef3]"), ("b", 0, "nothing")])
    found = citations.located(p, {"keys": citations.KEYS})
    assert sorted((r.doc_id, r.at, r.idx, r.start, r.match) for r in found.collect()) == [("a", 4, 0, 4, "[Ab1, Cd2]"), ("a", 19, 2, 9, "[Ef3]")]
    assert plan(found).count("LogicalRDD") == 1


def test_keys_of_an_entry_are_made_once(spark, sf):
    assert plan(references.key_issues(spark, sf)).count("knownnotcontainsnull(filter(array(left(") <= 1


def test_species_are_read_once(spark, sf):
    df = prose.species_issues(spark, sf)
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def test_species_keep_their_bounds(spark):
    rows = [("a", 0, "Éscherichia coli, xEscherichia coli, Escherichia coli-like, Escherichia coli, E. coli; q.Escherichia coli"), ("a", 1, "by escherichia coli")]
    p = paragraphs(spark, rows)
    assert [(r.kind, r.start) for r in species.read(p).orderBy("start").collect()] == [("f", rows[0][2].index("Escherichia coli, E.")), ("b", rows[0][2].index("E. coli"))]
    assert [(r.code, r.para_index) for r in species.issues(p, species.read(p)).where("code = 'lower_case_genus'").collect()] == [("lower_case_genus", 1)]


def test_spellings_are_searched_once(spark):
    p = paragraphs(spark, [("a", 0, "the colour, colours and color of grey xcolour colour_")])
    made = spelling.issues(spelling.found(p))
    assert [r.detail for r in made.collect()] == ["color American 1"]
    assert plan(made).count("regexp_extract_all") == plan(spelling.found(p)).count("regexp_extract_all")


def test_versions_are_split_once_each(spark):
    old = paragraphs(spark, [("a", 0, "One two three four. Gone now for good."), ("a", 1, "It stays. It stays."), ("b", 0, "Same here.")])
    new = paragraphs(spark, [("a", 0, "One two three five. Fresh words arrive. Fresh words arrive."), ("a", 2, "It stays."), ("b", 0, "Same here.")])
    made = manuscripts.changes(old, new)
    assert sorted((r.doc_id, r.idx, r.sentence, r.kind, r.similarity) for r in made.collect()) == [("a", 0, "Fresh words arrive.", "added", None)] * 2 + [("a", 0, "One two three five.", "edited", 0.833333)]
    assert plan(made).count("LogicalRDD") == 2 and "Join" not in plan(made)


def test_a_callout_begins_at_a_word(spark):
    told = legends.runs(paragraphs(spark, [("a", 0, "xFig. 1, Fig. 2a, SUPP. FIG. S3 and extended data figure 4")]))
    assert sorted((r.start, r.grp, r.number) for r in legends.callouts(told).collect()) == [(9, "main", 2), (18, "supplementary", 3), (36, "extended", 4)]
