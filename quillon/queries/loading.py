"""Incremental loads of slices of orders."""

from __future__ import annotations


from ..plans import load as L
from . import add, table

COLS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
NEW = ["o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice", "o_orderdate"]
T = f"(SELECT {', '.join(COLS)} FROM orders WHERE o_orderkey % 4 <> 0)"
S = f"(SELECT {', '.join(NEW)} FROM orders WHERE o_orderkey % 4 <> 1)"
K = ["o_orderkey"]
P, M, D = L.LoadPattern, L.MergeStrategy, L.DeleteStrategy


def sides(s, d):
    o = table(s, d, "orders")
    return o.filter("o_orderkey % 4 <> 0").select(*COLS), o.filter("o_orderkey % 4 <> 1").selectExpr(*NEW)


def run(pattern, **how):
    return lambda s, d: L.apply(*sides(s, d), L.LoadConfig(pattern, K, **how))


FULL = f"FROM {T} t FULL JOIN {S} s ON t.o_orderkey = s.o_orderkey"


def merged(moves: list[str], when: str = "s.o_orderkey IS NOT NULL") -> str:
    cells = [f"CASE WHEN t.o_orderkey IS NULL{f' OR ({when})' if c in moves else ''} THEN s.{c} ELSE t.{c} END AS {c}" for c in COLS[1:]]
    return f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, {', '.join(cells)} {FULL}"


DIFF = "s.o_orderkey IS NOT NULL AND (" + " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in COLS[1:]) + ")"
add("load_full", run(P.FULL_REFRESH), f"SELECT * FROM {S}")
add("load_append", run(P.APPEND_ONLY), f"SELECT * FROM {T} UNION ALL SELECT * FROM {S}")
add("load_upsert_all", run(P.UPSERT), merged(COLS[1:]))
add("load_upsert_changed", run(P.UPSERT, merge_strategy=M.UPDATE_CHANGED), merged(COLS[1:], DIFF))
add("load_upsert_selective", run(P.UPSERT, merge_strategy=M.UPDATE_SELECTIVE, update_columns=["o_orderstatus"]), merged(["o_orderstatus"]))
add("load_upsert_none", run(P.UPSERT, merge_strategy=M.UPDATE_NONE), merged([]))
add("load_upsert_actions", lambda s, d: L.upsert(*sides(s, d), L.LoadConfig(P.UPSERT, K, merge_strategy=M.UPDATE_CHANGED), with_action=True), merged(COLS[1:], DIFF).replace(FULL, f", CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN {DIFF} THEN 'update' ELSE 'keep' END AS _action {FULL}"))
add("load_delete_insert", run(P.DELETE_INSERT), f"SELECT * FROM {T} t WHERE NOT EXISTS (SELECT 1 FROM {S} s WHERE s.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM {S}")
add("load_incr_append", run(P.INCREMENTAL_APPEND), f"SELECT * FROM {T} UNION ALL SELECT * FROM {S} s WHERE NOT EXISTS (SELECT 1 FROM {T} t WHERE s.o_orderkey = t.o_orderkey)")
add("load_scd1", run(P.SCD_TYPE1), merged(COLS[1:]))
add("load_not_in_source", lambda s, d: L.not_in_source(*sides(s, d), L.LoadConfig(P.UPSERT, K)), f"SELECT * FROM {T} t WHERE NOT EXISTS (SELECT 1 FROM {S} s WHERE s.o_orderkey = t.o_orderkey)")


def by_time(**how):
    def q(s, d):
        o = table(s, d, "orders").select(*COLS)
        return L.apply(o.filter("o_orderdate < '1996-06-01'"), o, L.LoadConfig(P.INCREMENTAL_TIMESTAMP, incremental_column="o_orderdate", **how))

    return q


O = f"(SELECT {', '.join(COLS)} FROM orders)"
TIME = f"SELECT * FROM {O} WHERE o_orderdate < '1996-06-01' UNION ALL SELECT * FROM {O} WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < '1996-06-01'){{}}"
add("load_incr_ts", by_time(), TIME.format(""))
add("load_incr_ts_lookback", by_time(lookback_window="30 days"), TIME.format(" - INTERVAL 30 DAY"))
SCD = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate AS effective_from", "CASE WHEN o_orderkey % 6 = 1 THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '9999-12-31' END AS effective_to", "o_orderkey % 6 <> 1 AS is_current"]
NTZ = [c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for c in SCD]


def scd2(s, d):
    o = table(s, d, "orders")
    source = o.filter("o_orderkey % 4 <> 1").selectExpr(*NEW[:3])
    return L.apply(o.filter("o_orderkey % 4 <> 0").selectExpr(*NTZ), source, L.LoadConfig(P.SCD_TYPE2, K, hash_columns=["o_orderstatus", "o_totalprice"], as_of="2024-01-01"))


add("load_scd2", scd2, f"""WITH t AS (SELECT {', '.join(SCD)} FROM orders WHERE o_orderkey % 4 <> 0), s AS (SELECT {', '.join(NEW[:3])} FROM orders WHERE o_orderkey % 4 <> 1),
c AS (SELECT s.o_orderkey FROM t JOIN s USING (o_orderkey) WHERE is_current AND (t.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR t.o_totalprice IS DISTINCT FROM s.o_totalprice))
SELECT o_orderkey, o_orderstatus, o_totalprice, effective_from, CASE WHEN is_current AND o_orderkey IN (FROM c) THEN TIMESTAMP '2024-01-01' ELSE effective_to END AS effective_to, is_current AND o_orderkey NOT IN (FROM c) AS is_current FROM t
UNION ALL SELECT *, TIMESTAMP '2024-01-01', TIMESTAMP '9999-12-31', true FROM s WHERE o_orderkey IN (FROM c) OR o_orderkey NOT IN (SELECT o_orderkey FROM t WHERE is_current)""")
CDC = [*NEW, "CASE o_orderkey % 7 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS _op", "1 AS _seq"]
LATE = ["o_orderkey", "'Z' AS o_orderstatus", "o_totalprice", "o_orderdate", "CASE WHEN o_orderkey % 14 = 0 THEN 'U' ELSE 'D' END AS _op", "2 AS _seq"]
CS = f"(SELECT {', '.join(CDC)} FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT {', '.join(LATE)} FROM orders WHERE o_orderkey % 21 = 0 OR o_orderkey % 14 = 0)"


def cdc(strategy):
    def q(s, d):
        o = table(s, d, "orders")
        source = o.filter("o_orderkey % 4 <> 1").selectExpr(*CDC).unionByName(o.filter("o_orderkey % 21 = 0 OR o_orderkey % 14 = 0").selectExpr(*LATE))
        return L.apply(o.filter("o_orderkey % 4 <> 0").select(*COLS), source, L.LoadConfig(P.CDC_MERGE, K, delete_strategy=strategy))

    return q


def cdc_sql(where: str, extra: str = "") -> str:
    cells = [f"CASE WHEN s._op IS NULL OR s._op = 'D' THEN t.{c} ELSE s.{c} END AS {c}" for c in COLS[1:]]
    return f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, {', '.join(cells)}{extra} FROM {T} t FULL JOIN (SELECT * FROM {CS} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY _seq DESC) = 1) s ON t.o_orderkey = s.o_orderkey WHERE {where}"


add("load_cdc_hard", cdc(D.HARD_DELETE), cdc_sql("coalesce(s._op, '') <> 'D'"))
add("load_cdc_soft", cdc(D.SOFT_DELETE), cdc_sql("t.o_orderkey IS NOT NULL OR s._op <> 'D'", ", coalesce(s._op = 'D', false) AS is_deleted"))
add("load_cdc_ignore", cdc(D.IGNORE), cdc_sql("t.o_orderkey IS NOT NULL OR s._op <> 'D'"))
