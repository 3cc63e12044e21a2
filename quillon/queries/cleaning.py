"""Casts, imputation, encoding, removal of duplicates, and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rename_columns
from ..operators import casts, dedup, encode, impute, plots, pipeline
from . import add, made, table

BASE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS f"]
holed = made("lineitem", *BASE)
SQL = f"(SELECT {', '.join(BASE)} FROM lineitem)"
KEEP = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MODE = f"(SELECT f FROM {SQL} WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)"
add("fill_auto", lambda s, d: impute.fill_missing(holed(s, d)), f"SELECT {KEEP}, coalesce(q, (SELECT median(q) FROM {SQL})) AS q, coalesce(f, {MODE}) AS f FROM {SQL}")
add("fill_mean", lambda s, d: impute.fill_missing(holed(s, d), "mean").withColumn("q", F.round("q", 6)), f"SELECT {KEEP}, round(coalesce(q, (SELECT avg(q) FROM {SQL})), 6) AS q, f FROM {SQL}")
add("fill_median", lambda s, d: impute.fill_missing(holed(s, d), "median"), f"SELECT {KEEP}, coalesce(q, (SELECT median(q) FROM {SQL})) AS q, f FROM {SQL}")
add("fill_mode", lambda s, d: impute.fill_missing(holed(s, d), "mode", ["f"]), f"SELECT {KEEP}, q, coalesce(f, {MODE}) AS f FROM {SQL}")
add("fill_constant", lambda s, d: impute.fill_missing(holed(s, d), "constant", ["q"], -1), f"SELECT {KEEP}, coalesce(q, -1) AS q, f FROM {SQL}")
add("fill_drop", lambda s, d: impute.fill_missing(holed(s, d), "drop", ["q", "f"]), f"SELECT * FROM {SQL} WHERE q IS NOT NULL AND f IS NOT NULL")
events = made("events", "event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN value END AS value", "CASE WHEN event_id % 4 = 1 THEN event_type END AS event_type")
EVENTS = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS value, CASE WHEN event_id % 4 = 1 THEN event_type END AS event_type FROM events)"
for how, form in (("ffill", "last_value({c} IGNORE NULLS) OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), ("bfill", "first_value({c} IGNORE NULLS) OVER ({p}ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):
    for tag, keys, part in (("", None, ""), ("_by_key", ["user_id"], "PARTITION BY user_id ")):
        add(f"fill_{how}{tag}", lambda s, d, how=how, keys=keys: impute.fill_missing(events(s, d), how, ["value", "event_type"], order_by="event_id", keys=keys), f"SELECT event_id, user_id, {form.format(c='value', p=part)} AS value, {form.format(c='event_type', p=part)} AS event_type FROM {EVENTS}")
parts = made("part", "p_partkey", "CAST(p_size AS DOUBLE) AS size", "CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_retailprice END AS price")
KNN = """WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_retailprice END AS price FROM part),
n AS (SELECT a.p_partkey, o.price AS v, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.size - o.size), o.price) AS r FROM b a JOIN b o ON a.price IS NULL AND o.price IS NOT NULL),
m AS (SELECT p_partkey, avg(v) AS v FROM n WHERE r <= 5 GROUP BY 1)
SELECT b.p_partkey, size, round(coalesce(price, v), 6) AS price FROM b LEFT JOIN m USING (p_partkey)"""
add("fill_knn", lambda s, d: impute.knn_impute(parts(s, d), ["size", "price"]).withColumn("price", F.round("price", 6)), KNN)
add("onehot", lambda s, d: encode.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]), "SELECT o_orderkey, o_orderstatus = 'F' AS o_orderstatus_F, o_orderstatus = 'O' AS o_orderstatus_O, o_orderstatus = 'P' AS o_orderstatus_P FROM orders")
add("onehot_drop_first", lambda s, d: encode.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], drop_first=True), "SELECT o_orderkey, o_orderstatus = 'O' AS o_orderstatus_O, o_orderstatus = 'P' AS o_orderstatus_P FROM orders")
add("label_encode", lambda s, d: encode.label_encode(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), ["o_orderpriority", "o_custkey"], "o_orderkey"), "WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM orders GROUP BY 1), u AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM orders GROUP BY 1) SELECT o_orderkey, p.c AS o_orderpriority, u.c AS o_custkey FROM orders JOIN p USING (o_orderpriority) JOIN u USING (o_custkey)")
add("ordinal_encode", lambda s, d: encode.ordinal_encode(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "O"]), "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus FROM orders")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
add("auto_encode", lambda s, d: encode.auto_encode(table(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]), "SELECT c_custkey, " + ", ".join(f"c_mktsegment = '{x}' AS \"c_mktsegment_{x}\"" for x in SEGMENTS) + " FROM customer")
text_orders = made("orders", "' ' || CAST(o_orderkey AS STRING) AS `Order Key`", "CAST(o_totalprice AS STRING) AS `totalPrice`", "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS `Is-Even`", "date_format(o_orderdate, 'yyyy-MM-dd') AS `ORDERDate`", "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS `2nd`")
CAST_SQL = "SELECT o_orderkey AS {0}, o_totalprice AS {1}, o_orderkey % 2 = 0 AS {2}, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS {3}, {5} AS {4} FROM orders"
SECOND = "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END"
add("auto_cast", lambda s, d: casts.auto_cast(text_orders(s, d)), CAST_SQL.format('"Order Key"', '"totalPrice"', '"Is-Even"', '"ORDERDate"', '"2nd"', SECOND))
add("prepare_for_load", lambda s, d: casts.prepare(text_orders(s, d)), CAST_SQL.format("order_key", "totalprice", "is_even", "orderdate", "_2nd", f"nullif({SECOND}, '')"))
for conv, names in (("snake_case", ["order_key", "total_price", "is_even", "order_date", "2nd"]), ("camelCase", ["orderKey", "totalprice", "isEven", "orderdate", "2nd"]), ("PascalCase", ["OrderKey", "Totalprice", "IsEven", "Orderdate", "2nd"])):
    add(f"colnames_{conv.replace('Case', '')}", lambda s, d, conv=conv: rename_columns(text_orders(s, d), conv), "SELECT ' ' || o_orderkey AS \"{0}\", {6} AS \"{1}\", CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS \"{2}\", strftime(o_orderdate, '%Y-%m-%d') AS \"{3}\", {5} AS \"{4}\" FROM orders".format(*names, SECOND, "CAST(o_totalprice AS VARCHAR)"))
twice = made("events", "event_id", "user_id % 50 AS user_id", "event_type", "ts")
DEDUP = "SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts{0}, event_id{0}) AS r FROM (SELECT event_id, user_id % 50 AS user_id, event_type, ts FROM events)) WHERE r = 1"
add("dedup_first", lambda s, d: dedup.drop_duplicates(twice(s, d), ["user_id", "event_type"], "first", ["ts", "event_id"]), DEDUP.format(""))
add("dedup_last", lambda s, d: dedup.drop_duplicates(twice(s, d), ["user_id", "event_type"], "last", ["ts", "event_id"]), DEDUP.format(" DESC"))
add("dedup_none", lambda s, d: dedup.drop_duplicates(table(s, d, "events").select("event_id", "user_id"), ["user_id"], None), "SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n = 1")
add("dup_detect", lambda s, d: dedup.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_suppkey"]), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1")
add("fuzzy_dedup", lambda s, d: dedup.fuzzy_duplicates(table(s, d, "part").select("p_partkey", "p_name"), "p_name", 0.9, order_by="p_partkey"))
add("hist_bins", lambda s, d: plots.histogram(table(s, d, "lineitem"), "l_extendedprice", 20), "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
add("box_stats", lambda s, d: plots.box(table(s, d, "lineitem"), "l_extendedprice"), "SELECT q[1] AS q25, q[2] AS median, q[3] AS q75, min(l_extendedprice) FILTER (l_extendedprice >= q[1] - 1.5 * (q[3] - q[1])) AS low_whisker, max(l_extendedprice) FILTER (l_extendedprice <= q[3] + 1.5 * (q[3] - q[1])) AS high_whisker, count(*) FILTER (l_extendedprice < q[1] - 1.5 * (q[3] - q[1]) OR l_extendedprice > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) GROUP BY q")
add("trend_line", lambda s, d: plots.trend(table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"), "n"), "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, count(*) AS n FROM lineitem")
add("time_series", lambda s, d: plots.time_series(table(s, d, "events"), "ts", "value", "day").withColumn("mean", F.round("mean", 6)), "SELECT date_trunc('day', ts)::TIMESTAMP AS at, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
words = made("customer", "c_custkey", "'  Some   Text! ' || c_name AS `My Text`")
add("pipeline_steps", lambda s, d: pipeline.Pipeline(words(s, d)).fix_whitespace(strategy="normalize").fix_case(["My Text"], "upper").rename("snake_case").df, "SELECT c_custkey, upper(regexp_replace(trim('  Some   Text! ' || c_name), '\\s+', ' ', 'g')) AS my_text FROM customer")
