"""The pipeline over a small table with odd rows, against plain restatements of all its stages."""

import hashlib
import os
import subprocess
import sys

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from veldspar.llm import entry

from . import plain


def written(r, n):
    some = [str(x) for x in r.choice([f"{a}{b}{c}" for a in ("ba", "de", "mi", "so", "tu", "ra") for b in ("la", "ne", "ro", "ki", "") for c in ("ta", "m", "sa", "n", "lo", "ver", "s")], n)]
    return " ".join(x.capitalize() + ("." if k % 9 == 8 else "") if k % 9 == 0 else x + ("." if k % 9 == 8 else "") for k, x in enumerate(some))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(12)
    good = {i: written(r, int(r.integers(50, 120))) for i in range(100, 150)}
    junk = {i: " ".join(r.choice(["###", "$$$ !!!", "%% |", "x", "@@"], 60)) for i in range(200, 225)}
    passage, item = written(r, 60), written(r, 24)
    rows = list((good | junk).items())
    rows += [(300, written(r, 50) + "\n" + passage + " " + written(r, 30)), (301, written(r, 40) + " " + passage), (302, passage), (303, good[105]), (304, good[106].upper()), (305, good[107])]
    words = item.split()
    edited = " ".join("other" if k in (5, 12, 19) else w for k, w in enumerate(words))
    rows += [(310, written(r, 60) + " " + item + " " + written(r, 20)), (311, written(r, 60) + " " + edited), (312, written(r, 80) + " " + " ".join(words[:6]))]
    rows += [(400, None), (401, ""), (402, " \n\t"), (None, good[110]), (None, None), (None, written(r, 80)), (100, good[100]), (300, rows[75][1]), (403, written(r, 6000))]
    labels = [(i, 1) for i in range(100, 132)] + [(i, 0) for i in range(200, 216)] + [(401, 0), (None, 1), (133, None), (999, 1)]
    bench = [(1, item), (2, written(r, 9)), (3, None), (None, good[120]), (4, "")]
    to = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cuts int, leaked int, fp int")
    docs.write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 AS toxic").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to, rows, labels, bench


def by_hand(rows, labels, bench):
    """What is left of rows after each stage but the last."""
    known = {i: y for i, y in labels if i is not None and y is not None}
    single = lambda t: np.float32(plain.statistics(t)).tolist()
    fitted = [(single(t), known[i]) for i, t in rows if i in known]
    model = plain.grow(*map(list, zip(*fitted)))
    score = [model(single(t)) for _, t in rows]
    assert all(abs(s - 0.3) > 0.02 for s in score)
    first = [x for x, s in zip(rows, score) if s >= 0.3]
    prints = [plain.fingerprint(t) for _, t in first]
    root = plain.groups(dict(enumerate(prints)))
    least = {}
    for k, (i, _) in enumerate(first):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    nameless = [x for x in first if x[0] is None]
    second = dict(x for k, x in enumerate(first) if x[0] is not None and x[0] == least[root[k]])
    third = plain.without_repeats(second)
    items = [plain.words(t) for i, t in bench if i is not None and plain.words(t)]
    leaked = lambda t: any(plain.alignment(plain.words(t), q) >= 0.5 for q in items)
    fourth = {i: t for i, t in third.items() if not leaked(t)}
    return first, second, third, fourth, nameless


def test_pipeline_equals_the_stages_by_hand(spark, tables):
    to, rows, labels, bench = tables
    first, second, third, fourth, nameless = by_hand(rows, labels, bench)
    assert len(first) < len(rows) and {302, 303, 304, 305, 310, 311, 312} <= {i for i, _ in first} and not {303, 304, 305} & set(second)
    assert 302 not in third and len(third[301].split()) == 40 and third[300] == second[300]
    assert not {310, 311} & set(fourth) and 312 in fourth and len(nameless) >= 2
    sp = sentencepiece.SentencePieceProcessor(model_file=entry.tokenizer("piece_bpe_32k.model"))
    want = []
    for i, t in [*fourth.items(), *nameless]:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, to).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_keep_the_columns_of_documents(spark, tables):
    to = tables[0]
    docs = spark.read.parquet(f"{to}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, to).dtypes == docs.dtypes


@pytest.mark.parametrize("empty", [("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")])
def test_pipeline_over_empty_tables(spark, tables, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables[0]}/{name}.parquet")
        (df.where("false") if name in empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == 0 if "documents" in empty else n > 50


def test_pipeline_leaves_one_table_behind(spark, tables):
    from veldspar.llm.common import shared_dir

    top = shared_dir(spark).removeprefix("file://") + f"/veldspar/{spark.sparkContext.applicationId}"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    assert corpus_pipeline.run(spark, tables[0]).count() > 0
    assert [x.split("-")[0] for x in set(os.listdir(top)) - before] == ["decontamination"]


def test_nothing_is_left_when_the_application_ends(tables, tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print(corpus_pipeline.run(spark, "{tables[0]}").count(), sum(len(f) for _, _, f in os.walk("{tmp_path}/shared")))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=600)
    rows, files = map(int, done.stdout.split()[-2:])
    assert rows > 50 and files > 0 and not [f for _, _, f in os.walk(f"{tmp_path}/shared") if f]
