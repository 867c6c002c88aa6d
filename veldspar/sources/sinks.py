"""Reports, calendars and sheets as rows of text that Spark's writers can store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANKS = {"error": 0, "warning": 1, "info": 2}


def _rank():
    return F.create_map(*[F.lit(x) for p in _RANKS.items() for x in p])[F.col("severity")]


def text_report(issues: DataFrame) -> DataFrame:
    """(doc_id, report): a document's issues by severity and paragraph, and a line of counts."""
    line = F.concat_ws(" | ", F.upper("severity"), F.concat(F.lit("paragraph "), "para_index"), "code", "detail")
    rows = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(_rank().alias("r"), F.coalesce("para_index", F.lit(-1)).alias("p"), line.alias("line")))).alias("x"), *[F.count_if(F.col("severity") == s).alias(s) for s in _RANKS])  # a document's own issues
    counts = F.concat_ws(", ", *[F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in _RANKS])
    return rows.select("doc_id", F.concat(F.array_join(F.transform("x", lambda i: i["line"]), "\n"), F.lit("\n"), counts).alias("report"))


def json_report(issues: DataFrame) -> DataFrame:
    """(doc_id, report): {"file", "issues"} as JSON."""
    kept = F.struct(*[c for c in ("check", "severity", "code", "para_index", "detail")])
    rows = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(_rank().alias("r"), F.coalesce("para_index", F.lit(-1)).alias("p"), kept.alias("i")))).alias("x"))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("file"), F.transform("x", lambda i: i["i"]).alias("issues"))).alias("report"))


def exit_status(issues: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, status) of files (doc_id, error): 2 unreadable, 1 with an error, else 0."""
    bad = issues.where("severity = 'error'").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return files.join(bad, "doc_id", "left").select("doc_id", F.when(F.col("error").isNotNull(), 2).when(F.col("bad"), 1).otherwise(0).alias("status"))


def anchors(issues: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_index, start, size): where an issue's anchor stands in its paragraph: the whole anchor, else its first four words, else the paragraph."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = issues.join(paragraphs.select("doc_id", F.col("idx").alias("para_index"), flat("text").alias("t")), ["doc_id", "para_index"]).withColumns({"a": flat("anchor")}).withColumn("four", F.array_join(F.slice(F.split("a", " "), 1, 4), " "))
    whole, part = F.expr("locate(a, t)"), F.expr("locate(four, t)")
    return rows.select("doc_id", "para_index", F.when(whole > 0, whole - 1).when(part > 0, part - 1).otherwise(0).alias("start"), F.when(whole > 0, F.length("a")).when(part > 0, F.length("four")).otherwise(F.length("t")).alias("size"))


def fold(line: Column) -> Column:
    """A calendar line cut at 75 octets without cutting a character; later parts open with a space."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(a, c):
        n = F.octet_length(c)
        over = a["n"] + n > 75
        return F.struct(F.when(over, F.concat(a["out"], F.lit("\r\n "), c)).otherwise(F.concat(a["out"], c)).alias("out"), F.when(over, n + 1).otherwise(a["n"] + n).alias("n"))

    return F.when(F.octet_length(line) <= 75, line).otherwise(F.aggregate(F.split(line, ""), start, step)["out"])


def _escaped(c: Column) -> Column:
    """Text of a calendar: backslashes, semicolons, commas and line feeds are written with a backslash."""
    return F.replace(F.regexp_replace(c, r"([\\;,])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def calendar(events: DataFrame, stamp: date) -> DataFrame:
    """(person, calendar): a person's days (person, id, day, kind) as an iCalendar text of all-day events, each with an alarm a week before.

    stamp is the day on which the text is made.  An event is known by its id, kind and day, so a calendar that reads the text again changes it and adds none; of
    repeated rows one stands.  Rows without a person or a day are left out.
    """
    label = F.concat_ws(": ", "id", "kind")
    said = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    on = lambda name, c: F.concat(F.lit(f"{name};VALUE=DATE:"), F.date_format(c, "yyyyMMdd"))
    lines = [
        F.lit("BEGIN:VEVENT"), said("UID", _escaped(F.concat(F.concat_ws("-", "id", "kind", F.date_format("day", "yyyyMMdd")), F.lit("@veldspar")))), F.lit(f"DTSTAMP:{stamp:%Y%m%d}T000000Z"), on("DTSTART", F.col("day")), on("DTEND", F.date_add("day", 1)), said("SUMMARY", _escaped(label)),
        F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), said("DESCRIPTION", _escaped(label)), F.lit("TRIGGER:-P7D"), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    ]
    text = F.array_join(F.array(*[fold(x) for x in lines]), "\r\n")
    rows = events.where("person is not null and day is not null").select("person", F.struct("day", "id", "kind", text.alias("text")).alias("e"))
    per = rows.groupBy("person").agg(F.array_sort(F.array_distinct(F.collect_list("e"))).alias("x"))  # one person's events
    head = "\r\n".join(("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//veldspar//deadlines//EN", "CALSCALE:GREGORIAN", ""))
    return per.select("person", F.concat(F.lit(head), F.array_join(F.transform("x", lambda i: i["text"]), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("calendar"))


#: Columns of an order sheet, in order.
ORDER_SHEET = {"item": "Item", "vendor": "Vendor", "catalog": "Catalog number", "qty": "Quantity", "unit_price": "Unit price", "account": "Account", "status": "Status", "requested_by": "Requested by", "requested": "Date requested", "ordered": "Date ordered", "received": "Date received", "location": "Location", "notes": "Notes"}


def order_sheet(orders: DataFrame) -> DataFrame:
    """Orders under the sheet's column names, ready for write.csv(header=True); the importer reads them back."""
    return orders.select(*[F.col(c).cast("string").alias(n) for c, n in ORDER_SHEET.items()])


def sample_sheet(samples: DataFrame, kinds: list[str]) -> DataFrame:
    """Long analyses (sample, kind, status) as one row a sample, with a column for each kind's status."""
    wide = samples.groupBy("sample").pivot("kind", kinds).agg(F.first("status"))
    return wide.select("sample", *[F.col(f"`{k}`").alias(f"{k} status") for k in kinds])


def store(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON files, one folder a key on request; the commit protocol makes the write whole or absent."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
