"""Lab orders: totals, spending, alerts, catalogue, steps, inventory and search.

Orders have the columns of schemas.ORDER; `today` is always a parameter.  Money is
DECIMAL until the last step.  Every tie is broken by seq.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPENT = ("ordered", "backordered", "received")
STATUSES = ("requested", "approved", "ordered", "backordered", "received", "cancelled")
#: Allowed steps from each status.
STEPS = [("requested", "approved"), ("requested", "ordered"), ("approved", "ordered"), ("ordered", "received"), ("backordered", "received"), ("ordered", "backordered")] + [(s, "cancelled") for s in ("requested", "approved", "ordered", "backordered")]
SEARCHED = ("item", "vendor", "catalog", "account", "project", "requested_by", "location", "notes")
STOCK = ("item", "vendor", "catalog", "location", "sublocation", "notes")
COPIED = ("item", "vendor", "catalog", "qty", "unit_price", "unit_size", "url", "account", "project", "location", "sublocation")


def total() -> Column:
    """Quantity times unit price; null if either is unknown."""
    return (F.col("qty").cast("decimal(12,2)") * F.col("unit_price")).cast("decimal(28,4)")


def spend_date() -> Column:
    return F.coalesce("ordered", "received", "requested")


def _named(column: str) -> Column:
    return F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "Not set").otherwise(F.trim(column))


def _spent(orders: DataFrame, start: date | None, end: date | None) -> DataFrame:
    out = orders.where(F.col("status").isin(*SPENT) & total().isNotNull()).withColumn("day", spend_date()).where("day is not null")
    if start is not None:
        out = out.where(F.col("day") >= F.lit(start))
    return out if end is None else out.where(F.col("day") <= F.lit(end))


def _money(c: Column) -> Column:
    return c.cast("decimal(28,2)").cast("double")


def spend(orders: DataFrame, by: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """(name, spent, n) of committed priced orders within inclusive days, by account, vendor or month."""
    key = F.date_format("day", "yyyy-MM") if by == "month" else _named(by)
    rows = _spent(orders, start, end).groupBy(key.alias("name")).agg(F.sum(total()).alias("t"), F.count("*").alias("n"))
    return rows.select("name", _money(F.col("t")).alias("spent"), "n")


def spend_everywhere(orders: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """(by, name, spent, n): the three spendings in one pass, by grouping sets."""
    rows = _spent(orders, start, end).select(_named("account").alias("account"), _named("vendor").alias("vendor"), F.date_format("day", "yyyy-MM").alias("month"), total().alias("t"))
    sets = rows.groupingSets([[F.col("account")], [F.col("vendor")], [F.col("month")]], "account", "vendor", "month").agg(F.sum("t").alias("t"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 3, "account").when(F.col("g") == 5, "vendor").otherwise("month")
    return sets.select(by.alias("by"), F.coalesce("account", "vendor", "month").alias("name"), _money(F.col("t")).alias("spent"), "n")


def dashboard(orders: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """The largest twelve accounts, ten vendors and last twelve months, with each one's share of its grouping's largest."""
    rows = spend_everywhere(orders, start, end)
    order = [F.when(F.col("by") == "month", F.col("name")).desc_nulls_last(), F.col("spent").desc(), F.col("name")]
    w = Window.partitionBy("by")
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= F.when(F.col("by") == "vendor", 10).otherwise(12))
    return ranked.select("by", "name", "spent", "n", F.round(F.try_divide("spent", F.max("spent").over(w)), 6).alias("share"))


def totals(orders: DataFrame) -> DataFrame:
    """(status, n, total); unpriced orders count as nothing."""
    return orders.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce(total(), F.lit(0))).alias("t")).select("status", "n", _money(F.col("t")).alias("total"))


def periods(today: date) -> dict[str, date]:
    """First days of this month, this year and the last twelve months."""
    back = date(today.year - 1, today.month + 1, 1) if today.month < 12 else date(today.year, 1, 1)
    return {"month": today.replace(day=1), "year": today.replace(month=1, day=1), "twelve_months": back}


def _waiting(today: date, order_within: int = 7, deliver_within: int = 14) -> tuple[Column, Column]:
    """Since when an order waits, and the reason why it needs attention, if any."""
    since = F.when(F.col("status").isin("requested", "approved"), F.coalesce("approved", "requested")).when(F.col("status") == "ordered", F.col("ordered")).when(F.col("status") == "backordered", F.coalesce("ordered", "requested"))
    days = F.datediff(F.lit(today), since)
    return since, F.when(F.col("status") == "backordered", "backordered").when(F.col("status").isin("requested", "approved") & (days > order_within), "not_ordered").when((F.col("status") == "ordered") & (days > deliver_within), "not_delivered")


def attention(orders: DataFrame, today: date, order_within: int = 7, deliver_within: int = 14) -> DataFrame:
    """(id, reason, since, days): orders that wait too long (strictly), and every back-ordered one."""
    since, reason = _waiting(today, order_within, deliver_within)
    return orders.select("id", reason.alias("reason"), since.alias("since"), F.datediff(F.lit(today), since).alias("days")).where("reason is not null")


def catalogue(orders: DataFrame) -> DataFrame:
    """The latest order of each item, by its trimmed lower-case name."""
    named = orders.withColumn("key", F.lower(F.trim("item"))).where("key <> ''")
    w = Window.partitionBy("key").orderBy(F.desc_nulls_last("requested"), F.desc_nulls_last("seq"))  # columns that nobody asks for aren't carried along, and a task sends one row an item
    return named.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*orders.columns, "key")


def frequent(orders: DataFrame, n: int = 8) -> DataFrame:
    """(key, times): the n items most often ordered and not cancelled; of those, the ones ordered twice or more."""
    rows = orders.where("status <> 'cancelled'").groupBy(F.lower(F.trim("item")).alias("key")).agg(F.count("*").alias("times"), F.min("seq").alias("first")).where("key <> ''")
    return rows.orderBy(F.desc("times"), "first").limit(n).where("times > 1").select("key", "times")


def steps(orders: DataFrame) -> DataFrame:
    """(id, next) for every step that an order's status allows."""
    allowed = F.broadcast(orders.sparkSession.createDataFrame(STEPS, "status string, next string"))  # a fixed table
    return orders.select("id", "status").join(allowed, "status").select("id", "next")


def advance(orders: DataFrame, to: str, by: str, today: date) -> DataFrame:
    """Orders moved to a status: its date and person are set; a receipt without an order date gets one."""
    if to not in STATUSES:
        raise ValueError(f"no such status: {to}")
    day = F.lit(today)
    out = orders.withColumn("status", F.lit(to))
    if to == "approved":
        out = out.withColumns({"approved": day, "approved_by": F.lit(by)})
    elif to in ("ordered", "backordered"):
        out = out.withColumn("ordered", F.coalesce("ordered", day))
    elif to == "received":
        out = out.withColumns({"received": day, "received_by": F.lit(by), "ordered": F.coalesce("ordered", day)})
    return out


def replay(history: DataFrame) -> DataFrame:
    """(id, status, approved, ordered, received) from rows (id, day, status, seq): an order's state from its steps."""
    at = lambda *s: F.min(F.when(F.col("status").isin(*s), F.col("day")))
    rows = history.groupBy("id").agg(F.max_by("status", F.struct("day", "seq")).alias("status"), at("approved").alias("approved"), at("ordered", "backordered").alias("o"), at("received").alias("received"))
    return rows.select("id", "status", "approved", F.coalesce("o", "received").alias("ordered"), "received")


def order_again(orders: DataFrame, by: str, today: date) -> DataFrame:
    """New requests with an earlier order's particulars and no history."""
    return orders.select(*COPIED, F.lit("requested").alias("status"), F.lit(by).alias("requested_by"), F.lit(today).alias("requested"))


def autofill(drafts: DataFrame, orders: DataFrame) -> DataFrame:
    """Drafts without a vendor get what is blank from the catalogue's entry for the item."""
    known = catalogue(orders).select("key", *[F.col(c).alias(f"known_{c}") for c in ("vendor", "catalog", "unit_price", "unit_size", "url")])
    joined = drafts.withColumn("key", F.lower(F.trim("item"))).join(known, "key", "left")
    bare = F.trim(F.coalesce("vendor", F.lit(""))) == ""
    fill = lambda c: F.when(bare, F.coalesce(F.nullif(F.trim(c), F.lit("")), f"known_{c}")).otherwise(F.col(c))
    return joined.select(*[F.when(bare, F.coalesce("unit_price", "known_unit_price")).otherwise(F.col("unit_price")).alias(c) if c == "unit_price" else fill(c).alias(c) if c in ("vendor", "catalog", "unit_size", "url") else F.col(c) for c in drafts.columns])


def money(c: Column, currency: str) -> Column:
    return F.concat(F.lit(currency), F.format_number(c, 2))


def cell_number(c: Column, zero: bool = True) -> Column:
    """A typed number: commas and currency signs go; negatives (and, on request, zero) are refused as null."""
    n = F.regexp_replace(F.trim(c), r"[,$€£¥₹\s]", "").try_cast("double")
    return F.when((n > 0) | (F.lit(zero) & (n == 0)), n)


def find(orders: DataFrame, tile: str = "all", text: str = "", today: date | None = None) -> DataFrame:
    """Orders under a tile (all, attention, ordered with back-ordered, or a status) whose fields hold a text."""
    out = orders
    if tile == "attention":
        out = out.where(_waiting(today)[1].isNotNull())
    elif tile == "ordered":
        out = out.where(F.col("status").isin("ordered", "backordered"))
    elif tile != "all":
        out = out.where(F.col("status") == tile)
    return out.where(F.contains(F.lower(F.concat_ws(" ", *SEARCHED)), F.lit(text.lower()))) if text else out


def inventory(orders: DataFrame, text: str = "", cap: int = 200) -> DataFrame:
    """Received orders by place, newest first, `cap` rows a place at most (what a page shows); places without a name last."""
    out = orders.where("status = 'received'")
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *STOCK)), F.lit(text.lower())))
    place = F.nullif(F.trim(F.coalesce("location", F.lit(""))), F.lit(""))
    w = Window.partitionBy("place").orderBy(F.col("received").desc_nulls_last(), "seq")
    return out.withColumn("place", F.coalesce(place, F.lit("no location"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("place", "rank", "id", "item", "received")


def suggestions(orders: DataFrame, settings: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in settings (column `value`) and in history."""
    both = orders.select(F.trim(column).alias("value")).unionByName(settings.select(F.trim("value").alias("value")))
    return both.where("value <> ''").distinct()


def learned(orders: DataFrame, settings: DataFrame, column: str) -> DataFrame:
    """Values in orders that the settings lack."""
    return orders.select(F.trim(column).alias("value")).where("value <> ''").distinct().join(settings.select(F.trim("value").alias("value")), "value", "left_anti")


def in_load_order(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.col("requested").desc_nulls_last(), F.col("seq").desc())


def request_text(orders: DataFrame) -> DataFrame:
    """(id, text): an order as lines for a message; blank fields are left out."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(F.trim(c.cast("string")), F.lit("")))
    lines = [line(n.title(), F.col(n)) for n in ("item", "vendor", "catalog")] + [line("Quantity", F.col("qty").cast("decimal(12,2)")), line("Price", F.col("unit_price").cast("decimal(18,2)"))] + [line(n.title(), F.col(n)) for n in ("account", "project", "notes")]
    return orders.select("id", F.concat_ws("\n", *lines).alias("text"))
