"""Registered queries: modelling operators (M1-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prism.operators import model as M
from prism.operators.quality import drop_missing
from prism.plans.fixtures import CUSTOMER_NULLS_SQL, LINEITEM_NULLS_SQL, customer_nulls, lineitem_nulls
from prism.plans.registry import canon, canon_sql as R, register, round_doubles, table

TARGET, FEATURES = "l_extendedprice", ["l_quantity", "l_discount"]
KEY_SQL = "(l_orderkey * 7 + l_linenumber)"


def _key():
    return F.col("l_orderkey") * 7 + F.col("l_linenumber")


def _prepared(spark, sf):
    return M.regression_prep(table(spark, sf, "lineitem"), TARGET, FEATURES)


@register("regression_prep", f"WITH src AS ({LINEITEM_NULLS_SQL}) SELECT count(*) AS n_rows, {R('sum(l_tax)')} AS sum_tax FROM src "
          "WHERE l_extendedprice IS NOT NULL AND l_tax IS NOT NULL AND NOT isnan(l_tax) AND l_discount IS NOT NULL")
def q_regression_prep(spark, sf):
    prepared = M.regression_prep(lineitem_nulls(spark, sf), TARGET, ["l_tax", "l_discount"])
    return round_doubles(prepared.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_tax").alias("sum_tax")))


@register("train_test_split", f"SELECT CASE WHEN {KEY_SQL} % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n "
          "FROM lineitem GROUP BY 1")
def q_train_test_split(spark, sf):
    train, test = M.train_test_split(_prepared(spark, sf), _key())
    return (train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("split"), "n")
            .unionByName(test.agg(F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("split"), "n")))


_TRAIN_STATS = (f"WITH tr AS (SELECT * FROM lineitem WHERE {KEY_SQL} % 5 <> 0), "
                "s AS (SELECT var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, "
                "covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, "
                "avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM tr), "
                "b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
                "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM s), "
                "c AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b) ")


@register("linear_regression", _TRAIN_STATS + f"SELECT 'l_quantity' AS term, {R('b1', 4)} AS coefficient FROM c "
          f"UNION ALL SELECT 'l_discount', {R('b2', 4)} FROM c UNION ALL SELECT 'intercept', {R('b0', 4)} FROM c")
def q_linear_regression(spark, sf):
    train, _ = M.train_test_split(_prepared(spark, sf), _key())
    model = M.linear_regression(train, TARGET, FEATURES)
    return M.coefficient_table(spark, model, FEATURES).select("term", canon("coefficient", 4).alias("coefficient"))


@register("linear_regression_one_feature", f"SELECT 'l_quantity' AS term, {R('regr_slope(l_extendedprice, l_quantity)', 4)} AS coefficient "
          f"FROM lineitem WHERE {KEY_SQL} % 5 <> 0 UNION ALL SELECT 'intercept', {R('regr_intercept(l_extendedprice, l_quantity)', 4)} "
          f"FROM lineitem WHERE {KEY_SQL} % 5 <> 0")
def q_linear_regression_one_feature(spark, sf):
    prepared = M.regression_prep(table(spark, sf, "lineitem"), TARGET, ["l_quantity"])
    train, _ = M.train_test_split(prepared, _key())
    model = M.linear_regression(train, TARGET, ["l_quantity"])
    return M.coefficient_table(spark, model, ["l_quantity"]).select("term", canon("coefficient", 4).alias("coefficient"))


@register("regression_eval", _TRAIN_STATS + (
    f", te AS (SELECT l_extendedprice AS y, b0 + b1 * l_quantity + b2 * l_discount AS p FROM lineitem, c WHERE {KEY_SQL} % 5 = 0) "
    f"SELECT {R('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 4)} AS r2, {R('sum((y - p) * (y - p)) / count(*)', 4)} AS mse, "
    "count(*) AS n_test FROM te"))
def q_regression_eval(spark, sf):
    res = M.regression_analysis(table(spark, sf, "lineitem"), TARGET, FEATURES, _key())
    return res.metrics.select(canon("r2", 4).alias("r2"), canon("mse", 4).alias("mse"), "n_test")


SCALE_COLS = ["c_acctbal", "c_nationkey"]
CENTROIDS = [[-1.0, -1.0], [0.0, 0.0], [1.0, 1.0]]
_Z_SQL = (f"WITH src AS ({CUSTOMER_NULLS_SQL}), d AS (SELECT * FROM src WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)), "
          "st AS (SELECT avg(c_acctbal) AS ma, coalesce(nullif(stddev_pop(c_acctbal), 0), 1) AS sa, "
          "avg(c_nationkey) AS mn, coalesce(nullif(stddev_pop(c_nationkey), 0), 1) AS sn FROM d), "
          "z AS (SELECT c_custkey, c_acctbal, c_nationkey, (c_acctbal - ma) / sa AS za, (c_nationkey - mn) / sn AS zn FROM d, st) ")
_DIST = [f"((za - ({a})) * (za - ({a})) + (zn - ({b})) * (zn - ({b})))" for a, b in CENTROIDS]
_NC_SQL = _Z_SQL + (f", nc AS (SELECT *, {_DIST[0]} AS d0, {_DIST[1]} AS d1, {_DIST[2]} AS d2 FROM z), "
                    "a AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, "
                    "least(d0, d1, d2) AS dist2 FROM nc) ")


def _scaled(spark, sf):
    d = drop_missing(customer_nulls(spark, sf), ["c_acctbal"]).select("c_custkey", *[F.col(c).cast("double").alias(c) for c in SCALE_COLS])
    return M.standard_scale(d, SCALE_COLS, suffix="__z")


@register("standard_scale", _Z_SQL + f"SELECT c_custkey, {R('za')} AS c_acctbal__z, {R('zn')} AS c_nationkey__z FROM z")
def q_standard_scale(spark, sf):
    return round_doubles(_scaled(spark, sf).select("c_custkey", "c_acctbal__z", "c_nationkey__z"))


@register("nearest_centroid", _NC_SQL + f"SELECT c_custkey, cluster, {R('dist2')} AS dist2 FROM a")
def q_nearest_centroid(spark, sf):
    a = M.nearest_centroid(_scaled(spark, sf), ["c_acctbal__z", "c_nationkey__z"], CENTROIDS)
    return round_doubles(a.select("c_custkey", "cluster", "dist2"))


@register("cluster_profile", _NC_SQL + f"SELECT cluster, count(*) AS size, {R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct, "
          f"{R('avg(c_acctbal)')} AS mean_c_acctbal, {R('avg(c_nationkey)')} AS mean_c_nationkey FROM a GROUP BY cluster")
def q_cluster_profile(spark, sf):
    a = M.nearest_centroid(_scaled(spark, sf), ["c_acctbal__z", "c_nationkey__z"], CENTROIDS)
    return round_doubles(M.cluster_profile(a, "cluster", SCALE_COLS))


@register("kmeans_step", _NC_SQL + f"SELECT cluster, count(*) AS size, {R('avg(za)')} AS centre_acctbal, {R('avg(zn)')} AS centre_nationkey, "
          f"{R('sum(dist2)')} AS inertia FROM a GROUP BY cluster")
def q_kmeans_step(spark, sf):
    """One assign and update step of M6 from fixed centres."""
    a = M.nearest_centroid(_scaled(spark, sf), ["c_acctbal__z", "c_nationkey__z"], CENTROIDS)
    return round_doubles(a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("c_acctbal__z").alias("centre_acctbal"),
        F.avg("c_nationkey__z").alias("centre_nationkey"), F.sum("dist2").alias("inertia")))


# a feature that is twice another: the solution of least norm gives them shares of 1 : 2
@register("linear_regression_collinear", f"WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a "
          f"FROM lineitem WHERE {KEY_SQL} % 5 <> 0) SELECT 'l_quantity' AS term, {R('b / 5', 4)} AS coefficient FROM s "
          f"UNION ALL SELECT 'twice.it', {R('2 * b / 5', 4)} FROM s UNION ALL SELECT 'intercept', {R('a', 4)} FROM s")
def q_linear_regression_collinear(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("twice.it", F.col("l_quantity") * 2)
    prepared = M.regression_prep(li, TARGET, ["l_quantity", "twice.it"])
    train, _ = M.train_test_split(prepared, _key())
    model = M.linear_regression(train, TARGET, ["l_quantity", "twice.it"])
    return M.coefficient_table(spark, model, ["l_quantity", "twice.it"]).select("term", canon("coefficient", 4).alias("coefficient"))


K_ROUNDS = 4


def _kmeans_sql(k: int = 3) -> str:
    """Farthest-first centres, K_ROUNDS rounds and the profile, unrolled."""
    steps = ["z AS (SELECT *, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS za, "
             "(c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS zn FROM customer)",
             "f0 AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS n)"]
    apart = "(za - a) * (za - a) + (zn - n) * (zn - n)"
    for i in range(1, k + 1):
        steps.append(f"f{i} AS ({'' if i == 1 else f'SELECT * FROM f{i - 1} UNION ALL '}SELECT * FROM (SELECT {i} AS i, za AS a, zn AS n FROM ("
                     f"SELECT c_custkey, za, zn, min({apart}) AS d FROM z, f{i - 1} GROUP BY ALL) ORDER BY round(d, 9) DESC, za DESC, zn DESC LIMIT 1))")
    steps.append(f"c0 AS (SELECT * FROM f{k})")
    for r in range(K_ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, any_value(c_nationkey) AS c_nationkey, any_value(za) AS za, "
                     f"any_value(zn) AS zn, arg_min(i, {apart}) AS i, min({apart}) AS d FROM z, c{r} GROUP BY c_custkey)")
        mean = f"SELECT i, avg(za) AS a, avg(zn) AS n FROM a{r} GROUP BY i"
        if r == K_ROUNDS - 1:
            mean = f"SELECT row_number() OVER (ORDER BY a, n) - 1 AS i, a, n FROM ({mean})"
        steps.append(f"c{r + 1} AS ({mean})")
    return (f"WITH {', '.join(steps)} SELECT i::INT AS cluster, count(*) AS size, {R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct, "
            f"{R('avg(c_acctbal)')} AS mean_c_acctbal, {R('avg(c_nationkey)')} AS mean_c_nationkey, "
            f"{R('sum(sum(d)) OVER ()', 4)} AS inertia FROM a{K_ROUNDS} GROUP BY i")


@register("kmeans", _kmeans_sql())
def q_kmeans(spark, sf):
    """Seeding and a fixed number of rounds, which SQL can unroll."""
    res = M.kmeans(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], k=3, max_iter=K_ROUNDS, tol=-1.0)
    return round_doubles(res.profile.withColumn("inertia", canon(F.lit(res.inertia), 4)))
