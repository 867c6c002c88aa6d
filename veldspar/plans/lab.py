"""Queries over lab orders; the star schema's order lines stand for orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from veldspar.operators import lab

TODAY = date(2001, 8, 1)
START, END = date(1998, 1, 1), date(1999, 12, 31)

#: Both engines read orders through the same statement; it only renames and casts.
ORDERS = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(copy AS STRING)) AS id, concat(p_name, ' ', p_type) AS item, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE s_name END AS vendor, p_brand AS catalog,
       l_quantity AS qty, CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18, 4)) END AS unit_price, CAST('each' AS STRING) AS unit_size, CAST('' AS STRING) AS url,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS account, o_orderpriority AS project,
       CASE (l_orderkey * 7 + l_linenumber) % 8 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved' WHEN 2 THEN 'ordered' WHEN 3 THEN 'backordered' WHEN 4 THEN 'cancelled' ELSE 'received' END AS status,
       c_name AS requested_by, CAST(o_orderdate AS DATE) AS requested, CAST('' AS STRING) AS approved_by,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 8 = 1 THEN CAST(o_orderdate AS DATE) + 3 END AS approved,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 8 IN (2, 3, 6) THEN CAST(o_orderdate AS DATE) + 5 END AS ordered, CAST('' AS STRING) AS received_by,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 8 > 4 THEN CAST(l_shipdate AS DATE) END AS received,
       CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat('room ', CAST(l_partkey % 12 AS STRING)) END AS location, CAST('' AS STRING) AS sublocation, l_returnflag AS notes, (l_orderkey * 10 + l_linenumber) * 1000 + copy AS seq
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_returnflag) AS copy FROM (SELECT * FROM lineitem)) l
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
"""
WITH = f"WITH o AS ({ORDERS.replace('AS STRING', 'AS VARCHAR')}), p AS (SELECT *, CAST(CAST(qty AS DECIMAL(12, 2)) * unit_price AS DECIMAL(28, 4)) AS total, coalesce(ordered, received, requested) AS day FROM o)"
SPENT = "status IN ('ordered', 'backordered', 'received') AND total IS NOT NULL AND day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"
_sum = "CAST(CAST(sum(total) AS DECIMAL(28, 2)) AS DOUBLE)"
_name = lambda c: f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'Not set' ELSE trim({c}) END"


def orders(spark, sf_dir):
    """The statement above with its tables read from sf_dir."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier", "customer")}
    frames["lineitem"] = frames["lineitem"].repartition("l_orderkey")  # serves the window over an order's lines and the join with orders, so lines are shuffled once for both
    text = ORDERS
    for n in frames:
        text = text.replace(f"FROM {n})", f"FROM {{{n}}})").replace(f"JOIN {n} ON", f"JOIN {{{n}}} ON")
    return spark.sql(text, **frames)


def _spend_sql(by, key):
    return f"SELECT '{by}' AS \"by\", {key} AS name, {_sum} AS spent, count(*) AS n FROM p WHERE {SPENT} GROUP BY 2"


EVERYWHERE = " UNION ALL ".join(_spend_sql(by, "strftime(day, '%Y-%m')" if by == "month" else _name(by)) for by in ("account", "vendor", "month"))


def history(spark, sf_dir):
    """Events as steps of orders: a user's hour of events is an order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.create_map(*[F.lit(x) for p in (("signup", "requested"), ("view", "approved"), ("click", "ordered"), ("error", "backordered"), ("purchase", "received")) for x in p])[F.col("event_type")]
    return events.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH")).alias("id"), F.to_date("ts").alias("day"), step.alias("status"), F.col("event_id").alias("seq"))


QUERIES = {
    "lab01_total": (lambda s, d: orders(s, d).select("id", lab.total().cast("double").alias("total")), f"{WITH} SELECT id, CAST(total AS DOUBLE) AS total FROM p"),
    "lab02_replay": (
        lambda s, d: lab.replay(history(s, d)),
        """WITH h AS (SELECT concat(user_id, '-', strftime(ts, '%Y%m%d%H')) AS id, CAST(ts AS DATE) AS day, event_id AS seq,
             CASE event_type WHEN 'signup' THEN 'requested' WHEN 'view' THEN 'approved' WHEN 'click' THEN 'ordered' WHEN 'error' THEN 'backordered' WHEN 'purchase' THEN 'received' END AS status FROM events)
           SELECT id, arg_max(status, seq) AS status, min(day) FILTER (status = 'approved') AS approved, coalesce(min(day) FILTER (status IN ('ordered', 'backordered')), min(day) FILTER (status = 'received')) AS ordered,
             min(day) FILTER (status = 'received') AS received FROM h GROUP BY id""",
    ),
    "lab03_spend_date": (lambda s, d: orders(s, d).select("id", lab.spend_date().alias("day")), f"{WITH} SELECT id, day FROM p"),
    "lab04_spend_account": (lambda s, d: lab.spend(orders(s, d), "account", START, END), f"{WITH} SELECT name, spent, n FROM ({_spend_sql('account', _name('account'))})"),
    "lab04_spend_vendor": (lambda s, d: lab.spend(orders(s, d), "vendor", START, END), f"{WITH} SELECT name, spent, n FROM ({_spend_sql('vendor', _name('vendor'))})"),
    "lab04_spend_month": (lambda s, d: lab.spend(orders(s, d), "month", START, END), f"{WITH} SELECT strftime(day, '%Y-%m') AS name, {_sum} AS spent, count(*) AS n FROM p WHERE {SPENT} GROUP BY 1"),
    "lab04_spend_everywhere": (lambda s, d: lab.spend_everywhere(orders(s, d), START, END), f"{WITH} {EVERYWHERE}"),
    "lab05_totals": (lambda s, d: lab.totals(orders(s, d)), f"{WITH} SELECT status, count(*) AS n, CAST(CAST(sum(coalesce(total, 0)) AS DECIMAL(28, 2)) AS DOUBLE) AS total FROM p GROUP BY 1"),
    "lab06_periods": (lambda s, d: s.createDataFrame([(k, v) for k, v in lab.periods(TODAY).items()], "period string, first date"), "SELECT * FROM (VALUES ('month', DATE '2001-08-01'), ('year', DATE '2001-01-01'), ('twelve_months', DATE '2000-09-01')) t(period, first)"),
    "lab07_dashboard": (
        lambda s, d: lab.dashboard(orders(s, d), START, END),
        f"""{WITH}, e AS ({EVERYWHERE}), r AS (SELECT *, row_number() OVER (PARTITION BY "by" ORDER BY CASE WHEN "by" = 'month' THEN name END DESC NULLS LAST, spent DESC, name) AS k FROM e),
            t AS (SELECT * FROM r WHERE k <= CASE WHEN "by" = 'vendor' THEN 10 ELSE 12 END) SELECT "by", name, spent, n, round(spent / max(spent) OVER (PARTITION BY "by"), 6) AS share FROM t""",
    ),
    "lab08_attention": (
        lambda s, d: lab.attention(orders(s, d), TODAY),
        f"""{WITH}, a AS (SELECT id, status, CASE WHEN status IN ('requested', 'approved') THEN coalesce(approved, requested) WHEN status = 'ordered' THEN ordered WHEN status = 'backordered' THEN coalesce(ordered, requested) END AS since FROM o),
            b AS (SELECT *, CAST(date_diff('day', since, DATE '2001-08-01') AS INTEGER) AS days FROM a)
            SELECT id, reason, since, days FROM (SELECT *, CASE WHEN status = 'backordered' THEN 'backordered' WHEN status IN ('requested', 'approved') AND days > 7 THEN 'not_ordered' WHEN status = 'ordered' AND days > 14 THEN 'not_delivered' END AS reason FROM b) WHERE reason IS NOT NULL""",
    ),
    "lab09_catalogue": (
        lambda s, d: lab.catalogue(orders(s, d)).select("key", "id", F.col("unit_price").cast("double").alias("unit_price")),
        f"{WITH} SELECT lower(trim(item)) AS key, id, CAST(unit_price AS DOUBLE) AS unit_price FROM o WHERE trim(item) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(item)) ORDER BY requested DESC, seq DESC) = 1",
    ),
    "lab10_frequent": (
        lambda s, d: lab.frequent(orders(s, d)),
        f"{WITH} SELECT key, times FROM (SELECT lower(trim(item)) AS key, count(*) AS times, min(seq) AS first FROM o WHERE status <> 'cancelled' GROUP BY 1 ORDER BY times DESC, first LIMIT 8) WHERE times > 1",
    ),
    "lab12_order_again": (
        lambda s, d: lab.order_again(orders(s, d), "me", TODAY).select("item", "vendor", "qty", "status", "requested_by", "requested"),
        f"{WITH} SELECT item, vendor, qty, 'requested' AS status, 'me' AS requested_by, DATE '2001-08-01' AS requested FROM o",
    ),
    "lab13_autofill": (
        lambda s, d: lab.autofill(orders(s, d).where("status = 'requested'").withColumns({"catalog": F.lit("")}), orders(s, d).where("status <> 'requested'")).select("id", "vendor", "catalog"),
        f"""{WITH}, k AS (SELECT lower(trim(item)) AS key, vendor, catalog FROM o WHERE status <> 'requested' QUALIFY row_number() OVER (PARTITION BY lower(trim(item)) ORDER BY requested DESC, seq DESC) = 1)
            SELECT o.id, CASE WHEN o.vendor = '' THEN k.vendor ELSE o.vendor END AS vendor, CASE WHEN o.vendor = '' THEN k.catalog ELSE '' END AS catalog FROM o LEFT JOIN k ON lower(trim(o.item)) = k.key WHERE o.status = 'requested'""",
    ),
    "lab15_money": (lambda s, d: lab.totals(orders(s, d)).select("status", lab.money(F.col("total"), "EUR ").alias("money")), f"{WITH} SELECT status, concat('EUR ', format('{{:,.2f}}', CAST(CAST(sum(coalesce(total, 0)) AS DECIMAL(28, 2)) AS DOUBLE))) AS money FROM p GROUP BY 1"),
    "lab16_steps": (
        lambda s, d: lab.steps(orders(s, d)),
        f"""{WITH} SELECT id, next FROM o JOIN (VALUES ('requested', 'approved'), ('requested', 'ordered'), ('approved', 'ordered'), ('ordered', 'received'), ('backordered', 'received'), ('ordered', 'backordered'),
            ('requested', 'cancelled'), ('approved', 'cancelled'), ('ordered', 'cancelled'), ('backordered', 'cancelled')) t(status, next) USING (status)""",
    ),
    "lab17_learned": (
        lambda s, d: lab.learned(orders(s, d), s.createDataFrame([("room 1",), ("room 2",)], "value string"), "location"),
        f"{WITH} SELECT DISTINCT trim(location) AS value FROM o WHERE trim(location) NOT IN ('', 'room 1', 'room 2')",
    ),
    "lab19_cell_number": (
        lambda s, d: orders(s, d).select("id", lab.cell_number(F.concat(F.lit("$ "), F.format_number("unit_price", 2))).alias("n")),
        f"{WITH} SELECT id, CASE WHEN unit_price >= 0 THEN CAST(round(unit_price, 2) AS DOUBLE) END AS n FROM o",
    ),
    "flt06_orders": (
        lambda s, d: lab.find(orders(s, d), "attention", "machinery", TODAY).select("id"),
        f"""{WITH} SELECT id FROM o WHERE (status = 'backordered' OR status IN ('requested', 'approved') AND date_diff('day', coalesce(approved, requested), DATE '2001-08-01') > 7 OR status = 'ordered' AND date_diff('day', ordered, DATE '2001-08-01') > 14)
            AND contains(lower(concat_ws(' ', item, vendor, catalog, account, project, requested_by, location, notes)), 'machinery')""",
    ),
    "flt07_inventory": (
        lambda s, d: lab.inventory(orders(s, d)),
        f"""{WITH} SELECT place, CAST(rank AS INTEGER) AS rank, id, item, received FROM (SELECT coalesce(nullif(trim(location), ''), 'no location') AS place, id, item, received,
            row_number() OVER (PARTITION BY coalesce(nullif(trim(location), ''), 'no location') ORDER BY received DESC NULLS LAST, seq) AS rank FROM o WHERE status = 'received') WHERE rank <= 200""",
    ),
    "flt11_suggestions": (lambda s, d: lab.suggestions(orders(s, d), s.createDataFrame([("Zed",)], "value string"), "account"), f"{WITH} SELECT DISTINCT trim(account) AS value FROM o WHERE trim(account) <> '' UNION SELECT 'Zed'"),
    "snk08_request_text": (
        lambda s, d: lab.request_text(orders(s, d)),
        f"""{WITH} SELECT id, concat_ws(chr(10), concat('Item: ', nullif(trim(item), '')), concat('Vendor: ', nullif(trim(vendor), '')), CASE WHEN trim(catalog) <> '' THEN concat('Catalog: ', trim(catalog)) END,
            CASE WHEN qty IS NOT NULL THEN concat('Quantity: ', CAST(qty AS DECIMAL(12, 2))) END, CASE WHEN unit_price IS NOT NULL THEN concat('Price: ', CAST(unit_price AS DECIMAL(18, 2))) END,
            CASE WHEN trim(account) <> '' THEN concat('Account: ', trim(account)) END, CASE WHEN trim(project) <> '' THEN concat('Project: ', trim(project)) END, CASE WHEN trim(notes) <> '' THEN concat('Notes: ', trim(notes)) END) AS text FROM o"""
        .replace("concat('Item: ', nullif(trim(item), ''))", "CASE WHEN trim(item) <> '' THEN concat('Item: ', trim(item)) END").replace("concat('Vendor: ', nullif(trim(vendor), ''))", "CASE WHEN trim(vendor) <> '' THEN concat('Vendor: ', trim(vendor)) END"),
    ),
}
