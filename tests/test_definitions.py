"""Short forms are found from their brackets, as a pattern over the whole text finds them."""

import re

from veldspar.operators import manuscripts as m

FORWARDS = r"((?:[A-Za-z-]+ ){1,8})\(([A-Z][A-Za-z0-9]{1,9})\)"
TEXTS = [
    "the polymerase chain reaction (PCR) and a magnetic-resonance image (MRI), then polymerase chain reaction (PCR)",
    "one two three four five six seven eight nine alpha beta (AB) x9alpha beta (AB) é alpha beta (AB)", "alpha  beta (AB) alpha beta(AB) alpha beta (ab) alpha beta (ABCDEFGHIJKL)", "😀 alpha beta (AB) (CD) gamma delta (GD)", "alpha beta (A)", "", "no brackets at all",
]


def plain(text):
    for f in re.finditer(FORWARDS, text):
        words, letters = [w for w in re.split("[ -]", f[1].strip()) if w], re.sub("[^A-Z]", "", f[2].upper())
        last = words[-len(letters) :] if letters else []
        if len(letters) > 1 and len(words) >= len(letters) and "".join(w[0].upper() for w in last) == letters:
            yield f.start(), f[2], " ".join(last).lower()


def test_definitions_from_their_brackets(spark):
    rows = [("d", i, t, "results", False) for i, t in enumerate(TEXTS)]
    got = m.definitions(spark.createDataFrame(rows, "doc_id string, idx int, text string, section string, is_heading boolean"))
    assert sorted((r.idx, r.start, r.abbr, r.expansion) for r in got.collect()) == sorted((i, *x) for i, t in enumerate(TEXTS) for x in plain(t))
    assert "{1,8})\\(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no search that tries eight words from every word
