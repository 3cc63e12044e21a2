import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, text
from quillon.operators import anomaly, correlate, dedup, encode, impute, keys, plots, quality, validation
from quillon.operators import profile as P
from quillon.operators.pipeline import Pipeline
from quillon.plans import load as L
from quillon.sources.files import swap


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


def test_empty_table_has_profiles(spark):
    df = spark.createDataFrame([], "a long, b string, c boolean")
    assert [r.column_name for r in P.missing_values(df).collect()] == ["a", "b", "c"]
    assert P.numeric_profile(df).first()["count"] == 0
    assert quality.quality(df)["completeness"] == 0
    assert validation.validate(df)["errors"] == ["no rows"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert P.missing_values(df).first().null_count == 2


def test_moments_equal_pandas(spark):
    x = np.random.default_rng(1).gamma(2, size=200)
    import pandas as pd

    r = P.numeric_profile(spark.createDataFrame([(float(v),) for v in x], "x double")).first()
    s = pd.Series(x)
    assert r.skewness == pytest.approx(s.skew()) and r.kurtosis == pytest.approx(s.kurt()) and r.q25 == pytest.approx(s.quantile(0.25))


def test_kendall_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 6, (60, 2))]
    c = d = tx = ty = 0
    for (a, b), (e, f) in itertools.combinations(rows, 2):
        s = (a - e) * (b - f)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a != e), ty + (b != f)
    got = correlate.kendall(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    assert got == pytest.approx((c - d) / (tx * ty) ** 0.5)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert correlate.matrix(df).first().correlation is None
    assert anomaly.outliers(df, "zscore").count() == 0


def test_isolation_forest_finds_the_far_value(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(300)] + [(1000.0,), (None,)], "x double")
    assert 1000.0 in [r.x for r in anomaly.isolation_outliers(df, "x", contamination=0.01).collect()]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_fuzzy_equals_greedy(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(60)] + ["a long product name", "a long product nam", "another thing entirely", None]
    for t, keep in ((0.8, "first"), (0.6, "last")):
        rows = list(enumerate(words))
        kept = []
        for i, w in rows if keep == "first" else rows[::-1]:
            if w is None or all(v is None or (2 * lcs(v, w) / (len(v) + len(w)) if v or w else 1.0) < t - 1e-12 for _, v in kept):
                kept.append((i, w))
        got = dedup.fuzzy_duplicates(spark.createDataFrame(rows, "i long, w string"), "w", t, keep, "i")
        assert sorted(r.i for r in got.collect()) == sorted(i for i, _ in kept)


def test_drop_duplicates_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    assert sorted(r.i for r in dedup.drop_duplicates(df, ["k"], "last", ["i"]).collect()) == [2, 3]
    assert [r.i for r in dedup.drop_duplicates(df, ["k"], None).collect()] == [3]


def test_knn_without_usable_distance_takes_the_mean(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (None, None), (1.1, None)], "a double, b double")
    got = impute.knn_impute(df, ["a", "b"], 1).collect()
    assert (pytest.approx((1.0 + 2.0 + 1.1) / 3), 15.0) in [(r.a, r.b) for r in got]
    assert (1.1, 10.0) in [(r.a, r.b) for r in got]


def test_composite_key(spark):
    df = spark.createDataFrame([(o, n, "p") for o in range(5) for n in (1, 2)], "order_id long, line_number long, product string")
    assert keys.best_key(df, 0.7) == ["order_id", "line_number"]


def test_names():
    assert [text.standard_name(n) for n in ("First Name (Legal)", "2nd", " ", "Account Balance ($)")] == ["first_name_legal", "_2nd", "unnamed_column", "account_balance"]
    assert text.snake("HTTPServerName") == "http_server_name" and text.camel("User Name") == "userName"


def test_clashing_names_are_kept_apart(spark):
    assert text.rename_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a_B` int")).columns == ["a_b", "a_b_2"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-1-5",), ("13/02/2023",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(dates.format_date(F.col("s"))).collect()] == ["2024-01-05", "2023-02-13", "x", None]


def test_one_hot_of_nulls(spark):
    got = encode.one_hot(spark.createDataFrame([("b",), (None,), ("a",)], "c string"), ["c"])
    assert got.columns == ["c_a", "c_b"] and [tuple(r) for r in got.collect()] == [(False, True), (False, False), (True, False)]


def test_pipeline_and_log(spark):
    p = Pipeline(spark.createDataFrame([("  x ", 1)], "`My Col` string, n int")).run(["fix_whitespace", "standardize_columns", "no_such_step"])
    assert p.df.first().my_col == "x" and len(p.log) == 2 and p.reset().df.columns == ["My Col", "n"]


def cfg(pattern, **how):
    return L.LoadConfig(pattern, ["id"], **how)


def test_upsert_twice_changes_nothing(spark):
    t, s = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string"), spark.createDataFrame([(2, "b"), (3, None)], "id int, v string")
    once = L.apply(t, s, cfg(L.LoadPattern.UPSERT))
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, L.apply(once, s, cfg(L.LoadPattern.UPSERT)).collect())) == sorted(map(tuple, once.collect()))


def test_repeated_source_keys_are_refused(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    with pytest.raises(ValueError, match="one key"):
        L.apply(s.limit(1), s, cfg(L.LoadPattern.UPSERT))


def test_scd2_has_one_current_row_per_key(spark):
    d = dt.datetime(2020, 1, 1), dt.datetime(9999, 12, 31)
    t = spark.createDataFrame([(1, "a", *d, True), (2, "b", *d, True)], "id int, v string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean")
    out = L.apply(t, spark.createDataFrame([(2, None), (3, "c")], "id int, v string"), cfg(L.LoadPattern.SCD_TYPE2, hash_columns=["v"], as_of="2024-01-01"))
    assert out.count() == 4 and sorted(r.id for r in out.filter("is_current").collect()) == [1, 2, 3]


def test_config_is_checked():
    for bad in (L.LoadConfig(L.LoadPattern.UPSERT), cfg(L.LoadPattern.SCD_TYPE2), cfg(L.LoadPattern.UPSERT, merge_strategy=L.MergeStrategy.UPDATE_SELECTIVE)):
        with pytest.raises(ValueError):
            bad.validate()


def test_swap_replaces_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    swap(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]


def test_stream_equals_batch(spark, tmp_path):
    from quillon.streaming.loads import load_stream

    spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string").write.parquet(str(tmp_path / "in"))
    q = load_stream(spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in")), str(tmp_path / "t"), cfg(L.LoadPattern.UPSERT), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "b"), (2, "c")]


def test_skip_file(spark, tmp_path):
    """A file with a malformed row goes as a whole, with and without a schema."""
    from quillon.sources import files

    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("k,v\n3,z\n4,w,more\n")
    (tmp_path / "c.csv").write_text("k,v\n5,u\n")
    read = lambda **how: sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), on_error="SKIP_FILE", **how).collect())
    assert read() == [("1", "x"), ("2", "y"), ("5", "u")]
    assert read(schema="k int, v string") == [(1, "x"), (2, "y"), (5, "u")]
    (tmp_path / "c.csv").write_text("k,v\nfive,u\n")
    assert read(schema="k int, v string") == [(1, "x"), (2, "y")]


def test_consistency_of_variants(spark):
    from quillon.operators import quality

    df = spark.sql("SELECT parse_json(a) AS a, parse_json(b) AS b, c FROM VALUES ('1', '\"x\"', 'p'), ('\"y\"', '\"z\"', 'q'), (NULL, 'null', 'r') t(a, b, c)")
    assert abs(quality.consistency(df) - 200 / 3) < 1e-9 and quality.consistency(df.select("b", "c")) == 100


def test_isolation_sample_holds_values_as_often_as_they_come(spark):
    from quillon.operators import anomaly

    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 50.0 ELSE CAST(id % 3 AS DOUBLE) END AS x")
    scored = anomaly.isolation_scores(df, "x", trees=10, sample=64).groupBy("x").agg({"isolation_score": "max"}).collect()
    assert max(scored, key=lambda r: r[1])[0] == 50.0


def test_fix_email_at_the_last_sign(spark):
    from quillon.functions import validate as V

    df = spark.createDataFrame([("A@b@gmial.com",), ("a@gmial.com",)], "e string")
    assert [r[0] for r in df.select(V.fix_email(df.e)).collect()] == ["a@b@gmail.com", "a@gmail.com"]


def test_backward_fill_costs_as_much_as_forward(spark):
    """No frame may end unbounded: Spark walks such a frame again for each row."""
    rows = [(i % 2, None if i == 7 else i, i if i % 5 == 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    for keys in (None, ["k"]):
        got = impute.fill_missing(df, "bfill", ["v"], order_by="at", keys=keys)
        assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
        want = [(k, at, next((x[2] for x in sorted(rows, key=lambda x: -1 if x[1] is None else x[1]) if x[2] is not None and (x[1] or 0) >= (at or 0) and (not keys or x[0] == k)), None)) for k, at, _ in rows]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_knn_equals_brute_force(spark):
    """With many blocks, gaps everywhere and ties; copies of rows are compared once."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.integers(0, 6, (150, 3)), rng.normal(3, 2, (150, 3))]), 3)
    x[rng.random(x.shape) < 0.25] = np.nan
    m, k, want = 3, 4, []
    for row in x:
        n = (~np.isnan(x - row)).sum(1)
        dist = np.where(n > 0, np.sqrt(np.nansum((x - row) ** 2, 1) * m / np.maximum(n, 1)), np.inf)
        full = row.copy()
        for c in np.flatnonzero(np.isnan(row)):
            ok = np.flatnonzero(~np.isnan(x[:, c]) & np.isfinite(dist))
            best = ok[np.lexsort((x[ok, c], dist[ok]))[:k]]
            full[c] = x[best, c].mean() if len(best) else np.nanmean(x[:, c])
        want.append(full)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    for block in (40, 20_000):
        got = sorted(impute.knn_impute(df, ["a", "b", "c"], k, block).collect())
        assert np.allclose([tuple(r)[1:] for r in got], want) and [r.i for r in got] == list(range(300))


def test_knn_keeps_of_equal_donors_as_many_as_can_be_taken(spark):
    seen = []
    nearest = impute._nearest
    impute._nearest = lambda holes, donors, *a: (seen.append((holes, donors)), nearest(holes, donors, *a))[1]
    try:
        df = spark.range(3000).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS a", "CASE WHEN id % 20 <> 0 THEN CAST(id AS DOUBLE) END AS b")
        got = impute.knn_impute(df, ["a", "b"], 5).collect()
    finally:
        impute._nearest = nearest
    assert seen[0][0].count() == 3 and seen[0][1].count() == 15
    assert {r.b for r in got if r.id % 60 == 0} == {sum((3, 6, 9, 12, 15)) / 5}


def test_quantiles_equal_percentile(spark):
    """With intervals of any size, ties, infinite and missing values."""
    from quillon.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), int(c), None, None if i % 3 else float(a) * 1e300 * 1e10) for i, (a, b, c) in enumerate(zip(rng.lognormal(0, 9, 3000), rng.integers(0, 2, 3000), rng.integers(0, 9, 3000), strict=True))] + [(float("nan"), None, None, None, 0.0)], "a double, b double, c int, d double, e double")
    ps = [0.0, 0.25, 0.5, 0.749, 1.0]
    want = df.agg(*[F.percentile(P.present(df, c), F.array(*map(F.lit, ps))) for c in df.columns]).first()
    for limit in (1, 50, 100_000):
        assert repr(quantiles(df, dict.fromkeys(df.columns, ps), limit)) == repr({c: [None] * 5 if want[i] is None else [float(v) for v in want[i]] for i, c in enumerate(df.columns)})


@pytest.mark.parametrize("make", [
    lambda df: impute.fill_missing(df),
    lambda df: impute.fill_missing(df, "mode"),
    lambda df: impute.fill_missing(df, "median"),
    lambda df: plots.box(df, "x"),
    lambda df: anomaly.outliers(df, "iqr"),
    lambda df: P.numeric_profile(df),
])
def test_no_task_gets_all_distinct_values(spark, make, monkeypatch):
    """Neither percentile nor mode, whose states grow with the distinct values."""
    seen = []
    for name in ("percentile", "median", "mode"):
        monkeypatch.setattr(F, name, lambda *a, name=name, f=getattr(F, name): seen.append(name) or f(*a))
    df = spark.range(100).selectExpr("nullif(CAST(id AS DOUBLE), 3D) AS x", "nullif(CAST(id AS STRING), '3') AS s")
    make(df).collect()
    assert not seen


def test_a_task_of_the_median_reads_no_more_of_more_values(spark):
    """Bytes that the largest task reads of others, with as many distinct values as rows."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    for n in (100_000, 800_000):
        seen = stages()
        df = spark.range(0, n, 1, 4).selectExpr("CASE WHEN id % 8 <> 0 THEN id * 2654435761 % 4294967291 / 8D END AS x", "id")
        got = impute.fill_missing(df, "median").filter("id % 8 = 0").agg(F.min("x"), F.max("x"), F.count("x")).first()
        ids = np.arange(n)
        assert tuple(got) == (*[np.median((ids * 2654435761 % 4294967291 / 8)[ids % 8 != 0])] * 2, n // 8)
        assert 0 < max(s.shuffleReadBytes() / s.numTasks() for i, s in stages().items() if i not in seen) < 1_000_000


def test_quantiles_have_no_negative_zero(spark):
    """The two zeros are equal, so that which one is met first would decide."""
    from quillon.operators.quantiles import quantiles

    df = spark.range(100).selectExpr("IF(id < 60, -0D, 0D) AS x")
    for limit in (1, 100_000):
        assert repr(quantiles(df, {"x": [0.0, 0.5, 1.0]}, limit)) == repr({"x": [0.0] * 3})


def test_distinct_values_keep_their_types(spark):
    """No value goes through the exchange as text or hash; rows that lack one don't count."""
    df = spark.range(20000).selectExpr("id", "CAST(id % 7 AS INT) AS few", "IF(id % 2 = 0, 5, id) AS hot", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN double('NaN') ELSE id % 10 * 0D END AS x", "CAST(id % 3 AS STRING) AS s", "array(id % 2) AS a", "CAST(NULL AS DATE) AS never")
    assert {r.column_name: r.unique_count for r in P.distinct_counts(df).collect()} == {"id": 20000, "few": 7, "hot": 10000, "x": 1, "s": 3, "a": 2, "never": 0}
    sets = [("id", "few"), ("few", "hot"), ("s", "few"), ("few", "s"), ("id", "x"), ("id", "never")]
    got = keys.combination_stats(df, sets)
    assert {r.column_name: (r.cardinality, r.completeness) for r in got.collect()} == {"id,few": (20000, 1), "few,hot": (10006, 1), "s,few": (21, 1), "few,s": (21, 1), "id,x": (10000, 0.5), "id,never": (0, 0)}


def test_only_even_sets_are_grouped_after_the_exchange(spark):
    """Maps before it would hold nearly all rows of a set without repeats, but are needed for few or frequent values."""
    df = spark.range(20000).selectExpr("id", "id % 7 AS few", "IF(id % 2 = 0, 5, id) AS hot")
    for cols, direct in (("id", True), ("few", False), ("hot", False)):
        plan = P.distinct_sets(df, [(cols,)])._jdf.queryExecution().toString()
        assert ("RepartitionByExpression" in plan) == direct
