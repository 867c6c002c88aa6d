"""Order and sample sheets (CSV and XLSX) as rows, with headers found by their names.

Files are read as bytes, one file a row, and unpacked where they are; everything after the
grid of cells is DataFrame work keyed by the file.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names as letters only, by the field they fill.
ALIASES = {
    "item": ["item", "itemname", "product", "description"], "vendor": ["vendor", "supplier", "company"], "catalog": ["catalog", "catalognumber", "catno"], "qty": ["qty", "quantity", "amount"], "unit_price": ["unitprice", "price"], "total": ["total", "totalprice"],
    "account": ["account", "system", "grant"], "status": ["status", "state"], "requested_by": ["requestedby", "requester"], "requested": ["requested", "daterequested"], "ordered": ["ordered", "dateordered"], "received": ["received", "datereceived"], "location": ["location", "place"], "notes": ["notes", "comments"],
}
STATUS = {"requested": "requested", "new": "requested", "approved": "approved", "ordered": "ordered", "placed": "ordered", "backordered": "backordered", "backorder": "backordered", "received": "received", "arrived": "received", "cancelled": "cancelled", "canceled": "cancelled"}
#: The forms of a date, tried in this order; slashes are month first.
DATES = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy"]
HEADER_ROWS = 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _xlsx(data: bytes) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_MAIN}c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = 26 * at + ord(ch) - 64
                v = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def _grid(batches):
    for pdf in batches:
        rows = []
        for path, data in zip(pdf.path, pdf.content):
            try:
                table = _xlsx(data) if path.lower().endswith(".xlsx") else list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
                rows += [(path, i, cells, None) for i, cells in enumerate(table)]
            except (zipfile.BadZipFile, KeyError, ValueError, csv.Error, ElementTree.ParseError) as e:
                rows.append((path, -1, [], type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "row", "cells", "error"])


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells, error): cells of every CSV or XLSX file below a path; a damaged file is one row with an error."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_grid, "path string, row int, cells array<string>, error string")


def day(c: Column) -> Column:
    """A date written in any known way; null otherwise.  A year of two digits is one of 1969 to 2068."""
    century = lambda d, form: F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d) if form.endswith("/yy") else d
    return F.coalesce(*[century(F.try_to_date(F.trim(c), f), f) for f in DATES])


def number(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def _fields(cells: DataFrame, aliases: dict[str, list[str]], needs: str) -> DataFrame:
    """(path, row, field, value): cells below the first of HEADER_ROWS rows that names the needed field; the leftmost alias wins."""
    spark = cells.sparkSession
    names = F.broadcast(spark.createDataFrame([(a, f) for f, many in aliases.items() for a in many], "letters string, field string"))  # a fixed table
    each = cells.where("error is null").select("path", "row", F.posexplode("cells").alias("col", "value"))
    heads = each.where(F.col("row") < HEADER_ROWS).withColumn("letters", F.regexp_replace(F.lower("value"), "[^a-z]", "")).join(names, "letters")
    top = heads.where(F.col("field") == needs).groupBy("path").agg(F.min("row").alias("head"))
    chosen = heads.join(top, "path").where("row = head").groupBy("path", "head", "field").agg(F.min("col").alias("col"))
    return each.join(chosen, ["path", "col"]).where("row > head").select("path", "row", "field", F.trim("value").alias("value"))


def orders(cells: DataFrame) -> DataFrame:
    """Order rows with `problems`; rows without an item are skipped, a missing price comes from the total, a missing status from the dates."""
    wide = _fields(cells, ALIASES, "item").groupBy("path", "row").pivot("field", list(ALIASES)).agg(F.first("value"))
    known = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    text = lambda c: F.coalesce(c, F.lit(""))
    letters = F.regexp_replace(F.lower(text("status")), "[^a-z]", "")
    dates = {c: day(F.col(c)) for c in ("requested", "ordered", "received")}
    qty = F.coalesce(number(F.col("qty")), F.lit(1.0))
    price = F.coalesce(number(F.col("unit_price")), F.round(F.try_divide(number(F.col("total")), qty), 4))
    problems = [F.when((text(c) != "") & d.isNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c, d in dates.items()] + [F.when((letters != "") & F.try_element_at(known, letters).isNull(), F.concat(F.lit("status: "), F.col("status")))]
    status = F.coalesce(F.try_element_at(known, letters), F.when(dates["received"].isNotNull(), "received").when(dates["ordered"].isNotNull(), "ordered").otherwise("requested"))
    keep = [text(c).alias(c) for c in ("item", "vendor", "catalog", "account", "requested_by", "location", "notes")]
    return wide.where(text("item") != "").select("path", "row", *keep, qty.alias("qty"), price.cast("decimal(18,4)").alias("unit_price"), status.alias("status"), *[d.alias(c) for c, d in dates.items()], F.filter(F.array(*problems), lambda p: p.isNotNull()).alias("problems"))


def fingerprint() -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lower(F.trim("item")), F.lower(F.trim("vendor")), F.lower("catalog"), F.col("qty").cast("string"), F.col("requested").cast("string"), F.lower("requested_by")), 256)


def new_orders(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a sheet that neither the existing orders nor an earlier row of it hold."""
    marked = found.withColumn("mark", fingerprint())
    fresh = marked.join(existing.select(fingerprint().alias("mark")), "mark", "left_anti")
    return fresh.withColumn("copy", F.row_number().over(Window.partitionBy("mark").orderBy("path", "row"))).where("copy = 1").drop("copy", "mark")


def samples(cells: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, sample, kind, status, data, results): sample rows, long, for the analysis kinds a sheet's columns name."""
    aliases = {"sample": ["sample", "sampleid", "id", "samplename"], "description": ["description"]}
    for k in kinds:
        base = re.sub("[^a-z]", "", k.lower())
        aliases |= {f"{k}|status": [f"{base}status", f"{base}analysis"], f"{k}|data": [f"{base}data"], f"{k}|results": [f"{base}results"]}
    rows = _fields(cells, aliases, "sample")
    ids = rows.where("field = 'sample' and value <> ''").select("path", "row", F.col("value").alias("sample"))
    parts = rows.where(F.contains("field", F.lit("|"))).select("path", "row", F.split_part("field", F.lit("|"), F.lit(1)).alias("kind"), F.split_part("field", F.lit("|"), F.lit(2)).alias("what"), "value")
    wide = parts.groupBy("path", "row", "kind").pivot("what", ["status", "data", "results"]).agg(F.first("value"))
    return ids.join(wide, ["path", "row"]).select("path", "sample", "kind", F.when(F.lower("status").isin("planned", "running", "done", "failed"), F.lower("status")).alias("status"), "data", "results")
