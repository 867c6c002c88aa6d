"""License labels: what tells licenses apart, and the whole result against SQL."""

import duckdb
import pytest

from veldspar.llm import licenses

CASES = {
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License": "",
    "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa",
    "Creative Commons Attribution Non Commercial 4.0 International License": "",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",  # the base phrase stays
    "This work is licensed under the GNU General Public License version 2": "gpl-2",
    "This work is licensed under the GNU General Public License version 3": "gpl-3",
    "This work is licensed under the GNU Lesser General Public License version 3": "lgpl-3",
    "This work is licensed under the GNU Affero General Public License version 3": "agpl-3",
    "This work is licensed under the GNU General Public License": "",
    "Licensed under the Apache License, Version 1.1": "apache-1.1",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "Licensed under the Apache License": "",
    "This project is licensed under the terms of the Apache license": "",
    "This project is licensed under the terms of the MIT license. Commercial use is fine": "mit",
    "This project is licensed under the terms of the MIT license": "mit",
    "Nothing of the kind": "",
    licenses._MIT: "mit",
    licenses._BSD: "bsd",
    licenses._APACHE: "apache-2",
    licenses._MPL: "mpl-2",
    licenses._ISC.replace("for any purpose with", "for whatever purpose, with"): "isc",
    "intro " + licenses._MIT + " middle words here " + licenses._APACHE + " end": "apache-2,mit",
}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, None), (None, "Licensed under the Apache License, Version 2.0"), (0, list(CASES)[0]), (99, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_that_tell_licenses_apart(cases):
    got = {r.doc_id: r.labels for r in licenses.scan(cases).collect() if r.doc_id is not None}
    assert {t: got[i] for i, t in enumerate(CASES)} | {"": got[99]} == CASES | {"": ""}


def _equal(found, table):
    documents = table  # noqa: F841 (read by DuckDB)
    want = duckdb.sql(licenses.sql())
    assert want.columns == found.columns
    plain = lambda rows: sorted(((*r[:-1], round(r[-1], 9)) for r in rows), key=repr)
    assert plain(map(tuple, found.collect())) == plain(want.fetchall())


def test_cases_equal_sql(cases):
    _equal(licenses.scan(cases), cases.toArrow())


def test_documents_equal_sql(docs):
    _equal(licenses.scan(docs), docs.select("doc_id", "text").toArrow())


def test_altered_notices_equal_sql(spark):
    import numpy as np

    r, words, rows = np.random.default_rng(4), licenses.template_words(), []
    for i in range(150):
        out = []
        for t in r.integers(0, len(words), 3):
            w = [x if r.random() > 0.06 else str(r.choice(["and", "nc", "2", "commercial"])) for x in words[t]]
            out += [x for x in w if r.random() > 0.03] + list(r.choice(["the", "license", "words"], int(r.integers(0, 9))))
        rows.append((i, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _equal(licenses.scan(docs), docs.toArrow())
