"""What a callout names: numbers and panels, from the text after Fig. or Table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"S?\d+|and\b|[A-Za-z](?![a-z])|[-–—]|,|&", re.ASCII)


def parse(spec: str | None) -> list[dict]:
    """[{label, panels}] of a spec such as `1A-C, 2 and S3b`.

    A number opens an item; a dash between numbers fills what lies between; letters are
    panels of the item before them and a dash between letters fills the panels.  A
    lower-case letter that follows a space is prose, unless lower-case panels came before.
    """
    out: list[dict] = []
    span = lower = False
    last = ""
    at = 0
    for m in _TOKEN.finditer(spec or ""):
        t, gap = m[0], (spec or "")[at : m.start()]
        if gap.strip(" .()"):
            break
        at = m.end()
        if t[-1].isdigit():
            if span and last[-1:].isdigit() and out and t[0] == last[0] == "S" or span and last.isdigit() and t.isdigit():
                a, b = int(last.lstrip("S")), int(t.lstrip("S"))
                out += [{"label": ("S" if t[0] == "S" else "") + str(n), "panels": []} for n in range(a + 1, b + 1)] if a < b < a + 60 else [{"label": t, "panels": []}]
            else:
                out.append({"label": t, "panels": []})
            span, last = False, t
        elif len(t) == 1 and t.isalpha():
            if not out or (t.islower() and gap and not lower):
                break
            lower |= t.islower()
            up, before = t.upper(), last.upper()
            letters = [chr(c) for c in range(ord(before) + 1, ord(up) + 1)] if span and len(before) == 1 and before.isalpha() and before < up else [up]
            out[-1]["panels"] += [x for x in letters if x not in out[-1]["panels"]]
            span, last = False, t
        else:
            span = t in "-–—"
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("panels", T.ArrayType(T.StringType()))])))
def parse_spec(specs: pd.Series) -> pd.Series:
    return specs.map(parse)
