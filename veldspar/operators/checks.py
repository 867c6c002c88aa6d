"""All checks of a manuscript in their order, over the paragraphs of any number of documents."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import abbreviations, citations, journals, legends, manuscripts, species, spelling

NAMES = ("figures", "references", "abbreviations", "species", "consistency", "statements", "submission")


def _consistency(paragraphs: DataFrame) -> DataFrame:
    others = [df for code, df in manuscripts.consistency_issues(paragraphs).items() if code != "spelling"]
    return reduce(DataFrame.unionByName, [*others, spelling.issues(spelling.found(paragraphs))])


def _submission(paragraphs: DataFrame, rules: DataFrame | None, today: date | None) -> DataFrame:
    sizes = manuscripts.sizes(paragraphs)
    told = F.concat_ws(", ", *[F.concat_ws(" ", F.lit(c), F.col(c).cast("string")) for c in sizes.columns if c != "doc_id"])
    out = [manuscripts.issue(sizes, "submission", "info", "size", told, None)]
    if rules is not None:
        out += [journals.provenance(rules, today), journals.abstract_headings(paragraphs, rules), journals.required_sections(paragraphs, rules)]
    return reduce(DataFrame.unionByName, out)


def run(paragraphs: DataFrame, notes: DataFrame | None = None, rules: DataFrame | None = None, today: date | None = None, only: list[str] | None = None) -> DataFrame:
    """Issues of all seven checks, or of those named, with the check's place (check_rank); an issue that a check finds twice in a paragraph is one.

    notes: (doc_id, note_id, text, kind); rules: of `journals.assigned`, with the day that profiles are judged on; without rules no journal's are.  Documents
    without any issue have no row, but for the size that `submission` always gives.
    """
    if rules is not None and today is None:
        raise ValueError("rules need a day")
    made = {
        "figures": lambda: legends.issues(legends.runs(paragraphs)),
        "references": lambda: citations.issues(paragraphs, notes) if rules is None else citations.issues(paragraphs, notes).unionByName(journals.reference_issues(citations.listed(paragraphs), rules)),
        "abbreviations": lambda: abbreviations.issues(abbreviations.terms(paragraphs, abbreviations.read(paragraphs))),
        "species": lambda: species.issues(paragraphs, species.read(paragraphs)),
        "consistency": lambda: _consistency(paragraphs),
        "statements": lambda: reduce(DataFrame.unionByName, manuscripts.statement_issues(paragraphs).values()),
        "submission": lambda: _submission(paragraphs, rules, today),
    }
    wrong = sorted(set(only or ()) - set(NAMES))
    if wrong:
        raise ValueError(f"no check is called {', '.join(wrong)}")
    out = [made[name]().withColumn("check_rank", F.lit(k)) for k, name in enumerate(NAMES) if not only or name in only]
    return reduce(DataFrame.unionByName, out).dropDuplicates(["doc_id", "check", "severity", "code", "para_index", "detail"])


def in_order(issues: DataFrame) -> DataFrame:
    """Issues with `seq`, their place in a document's report: by check, paragraph, code and detail."""
    return issues.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("check_rank", F.coalesce("para_index", F.lit(-1)), "code", "detail")))
