"""License scans by diagonal voting.

All rolling hashes of K consecutive words are looked up in the templates'.  A semi-join filter beside
the texts drops those that no template has; the rest are joined in Spark with the template
positions and vote for the diagonal (place in the text less place in the
template).  Diagonals a few words apart are merged, which lets words be added or lost.  A span is verified:
the template's words that its votes cover must be a large enough share and hold all names and version numbers that tell the
license from others, and no word that turns a license into another (as `noncommercial`) may stand in or just after the span
unless the template has it.  Of spans that overlap, those go that another one beats by the words it covers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, as_bytes, chunks, save

K = 4
#: Words that neighbouring diagonals may differ by, the covered share that verifies a span, and words after it that are looked at.
DRIFT, COVER, AFTER = 6, 0.6, 3
#: Words of a stretch of a text in which overlaps are sought.
_STRETCH = 256

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words that a span must cover where its template has them.
NAMES = "affero apache attribution bsd cc gnu isc lesser mit mozilla nc nd noncommercial noderivatives sa sharealike".split()
#: Words that make another license of one, by the words of a family's templates.
MODIFIERS = {"cc attribution": "alike commercial derivatives derivs nc nd noncommercial noderivatives noderivs sa sharealike", "gnu": "affero lesser"}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice
may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""

#: Templates: public license texts and well-known notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", _MIT), ("bsd", _BSD), ("isc", _ISC), ("zlib", _ZLIB), ("unlicense", _UNLICENSE), ("apache-2", _APACHE), ("mpl-2", _MPL),
    ("apache-1.1", "licensed under the apache license version 1 1"), ("isc", "released under the isc license"), ("bsd", "released under the bsd license"), ("bsd", "this project is licensed under the terms of the bsd license"),
]


def _families() -> list[tuple[str, str]]:
    """Notices of the licenses that come in kinds and versions."""
    out = []
    for kind in ("", "nc", "sa", "nd", "nc sa", "nc nd"):
        long = " ".join(["attribution", *({"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}[k] for k in kind.split())])
        label = "-".join(["cc", "by", *kind.split()])
        forms = ["licensed under {label} 4 0", "this work is licensed under a creative commons {long} 4 0 international license", "creative commons {long} 4 0", "creative commons {long} 3 0 unported license"]
        out += [(label, f.format(label=label.replace("-", " "), long=long)) for f in forms]
    for short, name, versions in (("gpl", "gnu general public license", "2 3"), ("lgpl", "gnu lesser general public license", "2.1 3"), ("agpl", "gnu affero general public license", "3")):
        for v in versions.split():
            spaced = v.replace(".", " ")
            out += [(f"{short}-{v}", f"{name} version {spaced}"), (f"{short}-{v}", f"this work is licensed under the {name} version {spaced}")]
            out += [(f"{short}-{v}", f"this {what} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {spaced} of the license or at your option any later version") for what in ("program", "library")]
    return out


TEMPLATES += [x for x in _families() if x not in TEMPLATES]


def template_words() -> list[list[str]]:
    return [re.findall("[a-z0-9]+", text.lower()) for _, text in TEMPLATES]


def needed(label: str, words: list[str]) -> list[int]:
    """Places of a template's names and of the version in its label."""
    version = re.findall("[0-9]+", label)
    places = [i for i, w in enumerate(words) if w in NAMES]
    places += [i + 1 + j for i, w in enumerate(words) if w in ("version", "v") for j, v in enumerate(version) if words[i + 1 + j : i + 2 + j] == [v]]
    return sorted(set(places))


def refused(words: list[str]) -> list[str]:
    """The modifiers of a template's family that it doesn't have."""
    return sorted(m for names, listed in MODIFIERS.items() if set(names.split()) & set(words) for m in listed.split() if m not in words)


def _keys(phrase: str) -> np.ndarray:
    return Words([phrase.encode()], ALNUM).hash


def template_rows() -> list[tuple[int, int, int]]:
    """(gram, template, place) of every K-gram of the templates."""
    out = []
    for t, words in enumerate(template_words()):
        at, gram = Words([" ".join(words).encode()], ALNUM).grams(K)
        out += [(int(g), t, int(a)) for a, g in zip(at, gram.view(np.int64))]
    return out


def _scan(grams: np.ndarray):
    phrases = [(label, _keys(p)) for p, label in PHRASES.items()]
    key_of = {int(_keys(m)[0]): m for listed in MODIFIERS.values() for m in listed.split()}
    modifiers = np.array(sorted(key_of), np.uint64)
    by_key = [key_of[int(k)] for k in modifiers]

    def run(batches):
        for (ids,), texts in chunks(batches):
            w = Words(texts, ALNUM)
            who = w.text_of()
            places, names = [], [set() for _ in texts]
            for label, key in phrases:
                at = np.flatnonzero(w.hash[: len(w.hash) - len(key) + 1] == key[0]) if len(w.hash) >= len(key) else np.zeros(0, np.int64)
                for j in range(1, len(key)):
                    at = at[w.hash[at + j] == key[j]]
                at = at[who[at] == who[at + len(key) - 1]] if len(at) else at
                places.append(at)
                for d in who[at].tolist():
                    names[d].add(label)
            at = np.concatenate(places)
            owner = who[at] if len(at) else np.zeros(0, np.int64)
            n = np.bincount(owner, minlength=w.n)
            first, last = np.full(w.n, np.iinfo(np.int64).max), np.full(w.n, -1)
            np.minimum.at(first, owner, at)
            np.maximum.at(last, owner, at)
            start, hashed = w.grams(K)
            found = np.isin(hashed, grams)
            start, hashed = start[found], hashed[found].view(np.int64)
            cut = np.searchsorted(start, w.ptr)
            local = start - np.repeat(w.ptr[:-1], np.diff(cut))
            votes = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(hashed), pa.array(local, pa.int64())], names=["gram", "pos"]))
            mark = np.flatnonzero(np.isin(w.hash, modifiers))
            near = np.searchsorted(start, [mark - _FAR, mark + _FAR])  # votes within reach of each
            mark = mark[near[1] > near[0]]
            mcut = np.searchsorted(mark, w.ptr)
            names_of = np.searchsorted(modifiers, w.hash[mark])
            marks = pa.ListArray.from_arrays(pa.array(mcut, pa.int32()), pa.StructArray.from_arrays([pa.array(mark - np.repeat(w.ptr[:-1], np.diff(mcut)), pa.int64()), pa.array([by_key[i] for i in names_of.tolist()], pa.string())], names=["pos", "word"]))
            none = n == 0
            cols = [ids, pa.array(w.counts.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(first - w.ptr[:-1], mask=none), pa.array(last - w.ptr[:-1], mask=none)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([sorted(x) for x in names], pa.list_(pa.string())), votes, marks], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "votes", "marks"])

    return run


_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, votes array<struct<gram: long, pos: long>>, marks array<struct<pos: long, word: string>>"
#: Words from a vote beyond which no span reaches: the longest template's.
_FAR = 512


def _stretches(spans: DataFrame, after: int) -> DataFrame:
    """Each span in every stretch of its text that it touches."""
    reach = F.sequence(F.floor(F.col("start") / _STRETCH), F.floor((F.col("stop") + after - 1) / _STRETCH))
    return spans.withColumn("stretch", F.explode(reach))


def spans(votes: DataFrame, marks: DataFrame) -> DataFrame:
    """Verified spans (row, template, start, stop, covered, size) from votes (row, gram, pos) and modifiers (row, pos, word).

    Votes are distinct places, so their number is bounded by the text's words times a
    gram's places in the templates, both fixed by the input.
    """
    spark = votes.sparkSession
    rows = spark.createDataFrame(template_rows(), "gram long, template int, place int")
    words = template_words()
    facts = spark.createDataFrame([(t, len(x), needed(TEMPLATES[t][0], x), refused(x)) for t, x in enumerate(words)], "template int, size int, needed array<int>, refused array<string>")
    hits = votes.join(F.broadcast(rows), "gram").select("row", "template", "place", "pos", (F.col("pos") - F.col("place")).alias("diagonal"))  # a fixed table
    diagonals = hits.groupBy("row", "template", "diagonal").agg(F.collect_set("place").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= DRIFT, 0).otherwise(1)
    merged = diagonals.withColumn("group", F.sum(apart).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = merged.groupBy("row", "template", "group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("p"), F.min("low").alias("start"), (F.max("high") + K).alias("stop"))
    covered = F.expr(f"aggregate(transform(p, (x, i) -> least({K}, coalesce(get(p, i + 1) - x, {K}))), 0, (a, x) -> a + x)")
    held = F.expr(f"forall(needed, n -> exists(p, x -> x <= n AND n < x + {K}))")
    likely = whole.join(F.broadcast(facts), "template").withColumn("covered", covered).where((F.col("covered") / F.col("size") >= COVER) & held)  # a fixed table
    likely = save(likely.select("row", "template", "start", "stop", "covered", "size", "refused"), "spans")
    changed = _stretches(likely, AFTER).join(marks.withColumn("stretch", F.floor(F.col("pos") / _STRETCH)), ["row", "stretch"])
    changed = changed.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop") + AFTER) & F.array_contains("refused", F.col("word"))).select("row", "template", "start", "stop").distinct()
    true = likely.drop("refused").join(changed, ["row", "template", "start", "stop"], "left_anti")
    each = _stretches(true, 0)
    other = each.select("row", "stretch", *[F.col(c).alias(f"o_{c}") for c in ("template", "start", "stop", "covered", "size")])
    rank = lambda p: F.struct(F.col(f"{p}covered"), -F.col(f"{p}size"), -F.col(f"{p}template"))
    over = (F.col("start") < F.col("o_stop")) & (F.col("o_start") < F.col("stop")) & (rank("o_") > rank(""))
    beaten = each.join(other, ["row", "stretch"]).where(over).select("row", "template", "start", "stop").distinct()
    return true.join(beaten, ["row", "template", "start", "stop"], "left_anti")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty: no words, null places, empty labels, score 0.  The score is the best
    span's covered share, 1 for a base phrase.  Repeated rows and rows with a null id are scanned each by itself.
    """
    spark = docs.sparkSession
    grams = np.unique(np.array([r[0] for r in template_rows()], np.int64).view(np.uint64))
    found = as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(_scan(grams), _DDL)
    scanned = save(found.withColumn("row", F.monotonically_increasing_id()), "scan")  # stored, so that a row's number stays
    some = scanned.where(F.size("votes") > 0)
    votes = some.select("row", F.explode("votes").alias("v")).select("row", "v.gram", "v.pos")
    marks = some.select("row", F.explode("marks").alias("m")).select("row", "m.pos", "m.word")
    names = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(TEMPLATES)], "template int, label string")
    there = spans(votes, marks).join(F.broadcast(names), "template").groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("covered") / F.col("size")).alias("cover"))
    both = scanned.drop("votes", "marks").join(there, "row", "left")
    listed = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    labels = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("base").alias("base_labels"), listed(labels).alias("labels"), score.alias("score"))


def sql() -> str:
    """The scan as DuckDB SQL over the table documents, with words instead of hashes."""
    quoted = lambda x: "'" + x + "'"
    words = template_words()
    rows = ", ".join(f"({t}, {i}, {quoted(w)}, {str(i in set(needed(TEMPLATES[t][0], x))).lower()})" for t, x in enumerate(words) for i, w in enumerate(x))
    banned = ", ".join(f"({t}, {quoted(m)})" for t, x in enumerate(words) for m in refused(x))
    names = ", ".join(f"({t}, {quoted(label)})" for t, (label, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, p.split()))}])" for p, label in PHRASES.items())
    gram = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER s" for k in range(1, K)]])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
u AS (SELECT r, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w),
phrase(label, p) AS (VALUES {phrases}),
b AS (SELECT r, label, unnest(list_filter(range(len(ws) - len(p) + 1), lambda i: ws[i + 1:i + len(p)] = p)) AS pos FROM w, phrase),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY r),
tw(template, place, word, needed) AS (VALUES {rows}), tn(template, label) AS (VALUES {names}),
tg AS (SELECT template, place, {gram} AS gram FROM tw WINDOW s AS (PARTITION BY template ORDER BY place)), ts AS (SELECT template, count(*) AS size, count(*) FILTER (needed) AS needs FROM tw GROUP BY 1),
ug AS (SELECT r, pos, {gram} AS gram FROM u WINDOW s AS (PARTITION BY r ORDER BY pos)),
v AS (SELECT r, template, pos, place, pos - place AS diagonal FROM ug JOIN tg USING (gram)),
g AS (SELECT r, template, diagonal, sum(CASE WHEN diagonal - before <= {DRIFT} THEN 0 ELSE 1 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) AS before FROM (SELECT DISTINCT r, template, diagonal FROM v))),
vg AS (SELECT r, template, grp, pos, place FROM v JOIN g USING (r, template, diagonal)),
sp AS (SELECT r, template, grp, min(pos) AS start, max(pos) + {K} AS stop FROM vg GROUP BY 1, 2, 3),
cov AS (SELECT r, template, grp, count(*) AS covered, count(*) FILTER (needed) AS held FROM (SELECT DISTINCT r, template, grp, place + k AS place FROM vg, range({K}) t(k)) JOIN tw USING (template, place) GROUP BY 1, 2, 3),
likely AS (SELECT r, template, start, stop, covered, size FROM sp JOIN cov USING (r, template, grp) JOIN ts USING (template) WHERE covered / size >= {COVER} AND held = needs),
banned(template, word) AS (VALUES {banned}),
changed AS (SELECT DISTINCT l.r, l.template, l.start, l.stop FROM likely l JOIN banned USING (template) JOIN u ON u.r = l.r AND u.word = banned.word AND u.pos >= l.start AND u.pos < l.stop + {AFTER}),
tru AS (SELECT * FROM likely WHERE (r, template, start, stop) NOT IN (SELECT (r, template, start, stop) FROM changed)),
best AS (SELECT a.* FROM tru a WHERE NOT EXISTS (SELECT 1 FROM tru o WHERE o.r = a.r AND a.start < o.stop AND o.start < a.stop AND (o.covered > a.covered OR o.covered = a.covered AND (o.size < a.size OR o.size = a.size AND o.template < a.template)))),
more AS (SELECT r, list(DISTINCT label) AS labels, max(covered / size) AS cover FROM best JOIN tn USING (template) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""
