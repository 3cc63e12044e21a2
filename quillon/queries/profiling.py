"""Profiles, patterns, outliers, correlations, drift and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, correlate, dedup, drift, keys, quality
from ..operators import profile as P
from . import add, made, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]
HOLED = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE {c} END AS {c}"
holed = made("lineitem", "l_orderkey", "l_linenumber", *[HOLED.format(c=c) for c in LINE])
HOLED_SQL = f"(SELECT l_orderkey, l_linenumber, {', '.join(HOLED.format(c=c) for c in LINE)} FROM lineitem)"


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def each(columns, sql: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


# population moments from central sums, so that no engine's own correction matters
NUMERIC_SQL = """SELECT '{c}' AS column_name, n AS count, t - n AS null_count, round((t - n) * 100.0 / t, 6) AS null_pct, round(mu, 6) AS mean, round(sqrt(m2 / (n - 1)), 6) AS std, lo AS min, round(q[1], 6) AS q25, round(q[2], 6) AS median, round(q[3], 6) AS q75, hi AS max,
  round(sqrt(n * (n - 1.0)) / (n - 2) * (m3 / n) / pow(m2 / n, 1.5), 6) AS skewness, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / n / pow(m2 / n, 2) - 3) + 6), 6) AS kurtosis
FROM (SELECT count(*) AS t, count({c}) AS n, any_value(mu) AS mu, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q, sum(pow({c} - mu, 2)) AS m2, sum(pow({c} - mu, 3)) AS m3, sum(pow({c} - mu, 4)) AS m4 FROM @, (SELECT avg({c}) AS mu FROM @))"""
NUMBERS = ["null_pct", "mean", "std", "q25", "median", "q75", "skewness", "kurtosis"]
add("profile_numeric", lambda s, d: rounded(P.numeric_profile(holed(s, d), LINE), *NUMBERS), each(LINE, NUMERIC_SQL.replace("@", HOLED_SQL)))
add("profile_numeric_part", lambda s, d: rounded(P.numeric_profile(table(s, d, "part"), PART), *NUMBERS), each(PART, NUMERIC_SQL.replace("@", "part")))
flags = made("orders", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 200000 END AS large", "o_orderstatus = 'F' AS done")
FLAGS = "(SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 200000 END AS large, o_orderstatus = 'F' AS done FROM orders)"
add("profile_boolean", lambda s, d: rounded(P.boolean_profile(flags(s, d)), "true_pct"), each(["large", "done"], "SELECT '{c}' AS column_name, count(*) FILTER ({c}) AS true_count, count(*) FILTER (NOT {c}) AS false_count, round(count(*) FILTER ({c}) * 100.0 / count({c}), 6) AS true_pct FROM " + FLAGS))
add("profile_datetime", lambda s, d: P.datetime_profile(table(s, d, "events")), "SELECT 'ts' AS column_name, min(ts) AS min, max(ts) AS max, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS range_days FROM events")
TEXTS = ["p_name", "p_brand", "p_type"]
COUNTS = "(SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"
add("profile_text", lambda s, d: rounded(P.text_profile(table(s, d, "part"), TEXTS), "avg_length"), each(TEXTS, "SELECT '{c}' AS column_name, count({c}) AS count, round(avg(length({c})), 6) AS avg_length, CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length, (SELECT v FROM " + COUNTS.replace("{t}", "part") + " ORDER BY n DESC, v LIMIT 1) AS mode, (SELECT max(n) FROM " + COUNTS.replace("{t}", "part") + ") AS mode_count FROM part"))
ORD = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]
STATS = "SELECT '{c}' AS column_name, typeof(any_value({c})) AS dtype_, count(*) AS total, count(*) - count({c}) AS null_count, (count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_pct FROM orders"
add("column_stats", lambda s, d: rounded(P.column_stats(table(s, d, "orders"), ORD), "unique_pct").drop("dtype"), "SELECT * EXCLUDE (dtype_) FROM (" + each(ORD, STATS) + ")")
add("summary_stats", lambda s, d: rounded(P.summary_stats(table(s, d, "orders").select(*ORD, "o_totalprice")), "mean", "std", "unique_pct").select("column_name", "total", "unique_count", "unique_pct", "mean", "std"), each([*ORD, "o_totalprice"], "SELECT '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_pct, round(avg(TRY_CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(TRY_CAST({c} AS DOUBLE)), 6) AS std FROM orders").replace("avg(TRY_CAST(o_orderstatus AS DOUBLE))", "NULL::DOUBLE").replace("avg(TRY_CAST(o_orderpriority AS DOUBLE))", "NULL::DOUBLE"))
add("missing_values", lambda s, d: rounded(P.missing_values(holed(s, d)), "null_pct"), each(["l_orderkey", "l_linenumber", *LINE], "SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, (count(*) - count({c})) * 2 > count(*) AS mostly_missing, count(*) = count({c}) AS complete FROM " + HOLED_SQL))
add("cardinality", lambda s, d: rounded(P.cardinality(table(s, d, "orders"), ORD), "unique_pct"), each(ORD, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_pct, CASE WHEN count(DISTINCT {c}) * 100.0 / count(*) > 95 THEN 'high' WHEN count(DISTINCT {c}) * 100.0 / count(*) > 5 THEN 'medium' ELSE 'low' END AS level FROM orders"))
VALUES = ["p_brand", "p_size"]
add("value_counts", lambda s, d: P.value_counts(table(s, d, "part"), VALUES), each(VALUES, "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2"))
add("top_values", lambda s, d: P.top_values(table(s, d, "part"), VALUES, 5), each(VALUES, "SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INT) AS place FROM part GROUP BY 2) WHERE place <= 5"))
SHAPE = "CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 3 THEN 'normal' WHEN skewness > 1 THEN 'right-skewed' WHEN skewness < -1 THEN 'left-skewed' WHEN kurtosis > 3 THEN 'heavy-tailed' WHEN kurtosis < -1 THEN 'light-tailed' ELSE 'other' END AS shape"
add("distributions", lambda s, d: rounded(P.distributions(holed(s, d), LINE), "skewness", "kurtosis"), f"SELECT column_name, count, skewness, kurtosis, {SHAPE} FROM (" + each(LINE, NUMERIC_SQL.replace("@", HOLED_SQL)) + ")")


def quality_row(s, d):
    q = quality.quality(table(s, d, "orders").select(*ORD, "o_totalprice"))
    return s.createDataFrame([{k: round(v, 6) for k, v in q.items() if k != "interpretation"}], "completeness double, uniqueness double, validity double, consistency double, overall_score double")


ORD_U = ", ".join(f"count(DISTINCT {c}) * 100.0 / count(*) AS {c}" for c in [*ORD, "o_totalprice"])
add("quality_score", quality_row, f"SELECT 100.0::DOUBLE AS completeness, round(u, 6) AS uniqueness, 0.0::DOUBLE AS validity, 100.0::DOUBLE AS consistency, round(35 + 0.15 * u + 20, 6) AS overall_score FROM (SELECT (o_orderkey + o_custkey + o_totalprice + 100 - abs(o_orderstatus - 50) + 100 - abs(o_orderpriority - 50)) / 5 AS u FROM (SELECT {ORD_U} FROM orders))")
PAT = {
    "email": "CASE WHEN c_custkey % 10 < 8 THEN 'u' || c_custkey || '@example.com' ELSE 'none' END",
    "phone": "CASE WHEN c_custkey % 3 = 0 THEN '555-123-4567' ELSE '12' END",
    "url": "CASE WHEN c_custkey % 10 < 6 THEN 'https://example.com/' || c_custkey ELSE 'example' END",
    "ip": "'10.0.0.' || c_custkey",
    "money": "CASE WHEN c_custkey % 2 = 0 THEN '$' || c_custkey || '.00' ELSE 'free' END",
    "pct": "c_custkey || ' %'",
    "day": "CASE WHEN c_custkey % 4 < 3 THEN '2024-01-0' || (1 + c_custkey % 9) ELSE 'later' END",
}
pats = made("customer", *[f"{v} AS {k}" for k, v in PAT.items()])
RE = quality.PATTERNS
PAT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS pattern, round(count(*) FILTER ({('regexp_matches(' + c + ', ' + chr(39) + RE[k] + chr(39) + ')') if k in RE else 'coalesce(' + ', '.join(f'try_strptime({c}, {chr(39)}{f}{chr(39)})' for f in ('%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d')) + ') IS NOT NULL'}) * 100.0 / count({c}), 6) AS match_pct FROM (SELECT {', '.join(f'{v} AS {x}' for x, v in PAT.items())} FROM customer)" for c in PAT for k in [*RE, "date_string"])
add("patterns", lambda s, d: rounded(quality.patterns(pats(s, d)), "match_pct"), f"SELECT *, match_pct > 50 AS detected FROM ({PAT_SQL})")
PRICE = ["l_extendedprice", "l_quantity"]
IQR = "SELECT '{c}' AS column_name, count(*) FILTER ({c} < low OR {c} > high) AS outlier_count, round(count(*) FILTER ({c} < low OR {c} > high) * 100.0 / count({c}), 6) AS outlier_pct FROM lineitem, (SELECT @ FROM lineitem) GROUP BY ALL HAVING outlier_count > 0"
add("outliers_iqr", lambda s, d: rounded(anomaly.outliers(table(s, d, "lineitem"), "iqr", 0.3, PRICE), "outlier_pct"), each(PRICE, IQR.replace("@", "quantile_cont({c}, 0.25) - 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS low, quantile_cont({c}, 0.75) + 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high")))
add("outliers_zscore", lambda s, d: rounded(anomaly.outliers(table(s, d, "lineitem"), "zscore", 1.5, PRICE), "outlier_pct"), each(PRICE, IQR.replace("@", "avg({c}) - 1.5 * stddev_samp({c}) AS low, avg({c}) + 1.5 * stddev_samp({c}) AS high")))
add("outliers_iforest", lambda s, d: anomaly.isolation_outliers(table(s, d, "part"), "p_retailprice").select("p_partkey", "p_retailprice", F.round("isolation_score", 6).alias("isolation_score")))
PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
add("corr_pearson", lambda s, d: rounded(correlate.matrix(holed(s, d), LINE), "correlation"), " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM {HOLED_SQL}" for a, b in PAIRS))
RANKED = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)"
SP = ["l_quantity", "l_extendedprice", "l_discount"]
add("corr_spearman", lambda s, d: rounded(correlate.matrix(table(s, d, "lineitem"), SP, "spearman"), "correlation"), " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(x, y), 6) AS correlation FROM {RANKED.format(a=a, b=b)}" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
TAU = "SELECT 'p_size' AS column_a, 'p_retailprice' AS column_b, round(sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / sqrt(sum(abs(sign(a.x - b.x)) * a.n * b.n) * sum(abs(sign(a.y - b.y)) * a.n * b.n)), 6) AS correlation FROM g a, g b"
add("corr_kendall", lambda s, d: rounded(correlate.matrix(table(s, d, "part"), PART, "kendall"), "correlation"), f"WITH g AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS n FROM part GROUP BY ALL) {TAU}")
TGT = "SELECT '{c}' AS feature, round(corr({c}, y), 4) AS correlation, round(abs(corr({c}, y)), 4) AS abs_correlation FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS y FROM lineitem)"
add("target_corr", lambda s, d: correlate.target_correlation(table(s, d, "lineitem").select(*LINE, "l_returnflag"), "l_returnflag"), f"SELECT * FROM ({each(LINE, TGT)}) WHERE correlation IS NOT NULL")


def halves(s, d, columns):
    li = table(s, d, "lineitem").select(*columns, "l_shipdate")
    return li.filter("l_shipdate >= '1995-01-01'").select(*columns), li.filter("l_shipdate < '1995-01-01'").select(*columns)


NEW, OLD = "(SELECT * FROM lineitem WHERE l_shipdate >= '1995-01-01')", "(SELECT * FROM lineitem WHERE l_shipdate < '1995-01-01')"
add("drift_numeric", lambda s, d: rounded(drift.numeric_drift(*halves(s, d, PRICE)), "drift"), each(PRICE, f"SELECT '{{c}}' AS column_name, round((abs(a.m - b.m) + abs(a.s - b.s)) / 2, 6) AS drift FROM (SELECT avg({{c}}) AS m, stddev_samp({{c}}) AS s FROM {NEW}) a, (SELECT avg({{c}}) AS m, stddev_samp({{c}}) AS s FROM {OLD}) b"))
FLAG = ["l_returnflag", "l_linestatus"]
add("drift_categorical", lambda s, d: rounded(drift.categorical_drift(*halves(s, d, FLAG), FLAG), "drift"), each(FLAG, f"SELECT '{{c}}' AS column_name, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS drift FROM (SELECT {{c}} AS v, count(*) / sum(count(*)) OVER () AS p FROM {NEW} GROUP BY 1) a FULL JOIN (SELECT {{c}} AS v, count(*) / sum(count(*)) OVER () AS q FROM {OLD} GROUP BY 1) b USING (v)"))
add("key_stats", lambda s, d: rounded(keys.key_stats(table(s, d, "orders"), ORD), "uniqueness", "completeness"), each(ORD, "SELECT '{c}' AS column_name, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness, count({c}) / count(*) AS completeness, count(DISTINCT {c}) AS cardinality, count(*) AS total FROM orders"))


def candidates(s, d, name, columns):
    found = keys.detect_keys(table(s, d, name).select(*columns))
    return s.createDataFrame([(",".join(k.columns), round(k.confidence, 6), k.is_composite) for k in found], "columns string, confidence double, is_composite boolean")


add("key_single", lambda s, d: candidates(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), "SELECT 'o_orderkey' AS columns, least(1.0, 1.0)::DOUBLE AS confidence, false AS is_composite FROM orders HAVING count(DISTINCT o_orderkey) = count(*)")
SETS = [("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey")]
add("key_composite", lambda s, d: rounded(keys.combination_stats(table(s, d, "lineitem"), SETS), "uniqueness"), " UNION ALL ".join(f"SELECT '{a},{b}' AS column_name, round(count(DISTINCT ({a}, {b})) / count(*), 6) AS uniqueness, 1.0::DOUBLE AS completeness, count(DISTINCT ({a}, {b})) AS cardinality, count(*) AS total FROM lineitem" for a, b in SETS))
add("key_analyze", lambda s, d: rounded(keys.analyze_key(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]), "uniqueness_pct"), "SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_combinations, round(count(*) * 100.0 / sum(n), 6) AS uniqueness_pct, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, 0::BIGINT AS null_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)")
add("key_duplicates", lambda s, d: keys.duplicate_keys(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"]), "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1 ORDER BY n DESC, l_partkey, l_suppkey LIMIT 10")


def validation(s, d):
    v = keys.validate_keys(table(s, d, "lineitem"), ["l_orderkey"])
    return s.createDataFrame([(v["valid"], v["null_counts"]["l_orderkey"], v["duplicate_rows"])], "valid boolean, null_rows long, duplicate_rows long")


add("key_validate", validation, "SELECT coalesce(sum(n) FILTER (n > 1), 0) = 0 AS valid, 0::BIGINT AS null_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
add("dup_summary", lambda s, d: dedup.duplicate_summary(table(s, d, "events"), ["user_id", "event_type"]), "SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, sum(n - 1)::BIGINT AS surplus_rows, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
