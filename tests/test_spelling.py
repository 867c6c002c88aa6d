"""Words with two spellings."""

from veldspar.operators import spelling as s

from .test_citations import issues, paper


def test_the_table_is_made_by_rule():
    words = {w: (f, b) for w, f, b in s.table()}
    for british, american in (("colours", "colors"), ("behavioural", "behavioral"), ("analysed", "analyzed"), ("randomisation", "randomization"), ("centre", "center"), ("modelling", "modeling"), ("faecal", "fecal"), ("oedema", "edema"), ("grey", "gray"), ("sulphate", "sulfate"), ("ageing", "aging"), ("mouldy", "moldy"), ("catalogue", "catalog")):
        assert words[british][0] == words[american][0] and words[british][1] and not words[american][1]
    assert len({f for f, _ in words.values()}) > 60
    assert not [w for w, (f, b) in words.items() if " " in w]


def test_words_are_found_whole_and_names_kept(spark):
    p = paper(spark, ("results", "Colour and color, discoloured COLOURS. Centre of the Cancer Center: Center"), ("references", "colour"), ("front_matter", "colour"), ("results", None))
    assert sorted((r.idx, r.start, r.word, r.british) for r in s.found(p).collect()) == [(0, 0, "colour", True), (0, 11, "color", False), (0, 39, "centre", True), (0, 68, "center", False)]
    alone = paper(spark, ("front_matter", "grey"), ("references", "gray"))
    assert [r.word for r in s.found(alone).collect()] == ["grey"]


def test_the_minority_is_named(spark):
    p = paper(spark, ("results", "colour, behaviour and fibre"), ("results", "the colors and color of a gray color"))
    assert issues(s.issues(s.found(p))) == [("spelling", 0, "behaviour British 1"), ("spelling", 0, "colour British 1"), ("spelling", 0, "fibre British 1")]
    tie = paper(spark, ("results", "colour and center"))
    assert issues(s.issues(s.found(tie))) == [("spelling", 0, "center American 1")]
    assert issues(s.issues(s.found(paper(spark, ("results", "colour and centre"))))) == []
    often = paper(spark, ("results", "grey greys behaviour behaviours colour colours"), ("results", "color colors colors"))
    assert issues(s.issues(s.found(often))) == [("spelling", 1, "colors American 3")]
