"""Feature matching and 2-D registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, sql_rnd
from topiclens.catalog.standins import feature_pairs, features, matches, table, with_sql
from topiclens.operators import geometry as G
from topiclens.operators import matching as M
from topiclens.operators import statistics as T

PAIRS = with_sql("features", "candidates")
MATCHES = with_sql("matches")


def _near_sql(where="true"):
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, query_id ORDER BY d, target_id) AS rn FROM candidates WHERE {where}),
        near AS (SELECT pair_id, query_id, max(CASE WHEN rn = 1 THEN target_id END) AS target_id, max(CASE WHEN rn = 1 THEN d END) AS d1,
        max(CASE WHEN rn = 2 THEN d END) AS d2 FROM ranked WHERE rn <= 2 GROUP BY 1, 2)"""


@query(PAIRS + ", " + _near_sql() + f" SELECT pair_id, query_id, target_id AS best_id, {sql_rnd('d1')} AS d1, {sql_rnd('d2')} AS d2 FROM near")
def nearest_features(spark, d):
    near = M.nearest_features(*feature_pairs(spark, d))
    return near.select("pair_id", "query_id", "best_id", rnd("d1").alias("d1"), rnd("d2").alias("d2"))


MATCHED = """SELECT n.pair_id, n.query_id, n.target_id, c.x1, c.y1, c.x2, c.y2, """ + sql_rnd("(c.s1 + c.s2) / 2") + """ AS weight
    FROM near n JOIN candidates c USING (pair_id, query_id, target_id) WHERE d1 / nullif(d2, 0) < """


def _shown(found):
    return found.select("pair_id", "query_id", "target_id", "x1", "y1", "x2", "y2", rnd("weight").alias("weight"))


@query(PAIRS + ", " + _near_sql() + " " + MATCHED + "0.97")
def match_features(spark, d):
    return _shown(M.match_features(*feature_pairs(spark, d), rod=0.97))


@query(PAIRS + ", " + _near_sql("s2 / s1 >= 1 / 1.5 AND s2 / s1 <= 1.5") + " " + MATCHED + "0.97")
def match_features_scaled(spark, d):
    """Only features of similar size."""
    return _shown(M.match_features(*feature_pairs(spark, d), rod=0.97, max_size_ratio=1.5))


@query(PAIRS + ", " + _near_sql() + ", m AS (" + MATCHED + """1.5)
    SELECT pair_id, query_id, target_id, x1, y1, x2, y2, weight FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, x2, y2) AS n FROM m) WHERE n = 1""")
def drop_ambiguous(spark, d):
    return _shown(M.drop_ambiguous(M.match_features(*feature_pairs(spark, d), rod=1.5)))


@query(PAIRS + "SELECT a.vec_id AS v1, b.vec_id AS v2 FROM features a JOIN features b ON b.image_id = a.image_id + 1 AND b.x = a.x AND b.y = a.y "
       "WHERE b.scale / a.scale >= 1 / 1.5 AND b.scale / a.scale <= 1.5")
def scale_band(spark, d):
    """Features at the same place of the next image with a similar size."""
    f = features(spark, d)
    left = f.select("image_id", "x", "y", F.col("scale").alias("s1"), F.col("vec_id").alias("v1"))
    right = f.select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("scale").alias("s2"), F.col("vec_id").alias("v2"))
    return left.join(right, ["image_id", "x", "y"]).filter(M.size_ratio_in_band("s1", "s2", 1.5)).select("v1", "v2")


@query("SELECT query_id, best_id, " + sql_rnd("d1") + " AS d1, " + sql_rnd("d2") + """ AS d2 FROM (SELECT query_id, max(CASE WHEN rn = 1 THEN t END) AS best_id,
    max(CASE WHEN rn = 1 THEN d END) AS d1, max(CASE WHEN rn = 2 THEN d END) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, t) AS rn
    FROM (SELECT l_partkey AS query_id, l_suppkey AS t, min(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2)) WHERE rn <= 2 GROUP BY 1)""")
def best_two(spark, d):
    """The two cheapest suppliers of every part."""
    offers = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("target_id")).agg(F.min("l_extendedprice").alias("d"))
    return M.best_two(offers, ["query_id"]).select("query_id", "best_id", rnd("d1").alias("d1"), rnd("d2").alias("d2"))


def _clouds(spark, d):
    m = matches(spark, d)
    p = m.select("pair_id", F.col("match_id").alias("query_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    q = m.select("pair_id", F.col("match_id").alias("target_id"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return p, q


@query(MATCHES + """SELECT a.pair_id, a.match_id AS query_id, arg_min(b.match_id, (sqrt((a.x1 - b.x2) * (a.x1 - b.x2) + (a.y1 - b.y2) * (a.y1 - b.y2)), b.match_id)) AS target_id
    FROM matches a JOIN matches b USING (pair_id) GROUP BY 1, 2""")
def nearest_point(spark, d):
    return M.nearest_point(*_clouds(spark, d)).select("pair_id", "query_id", "target_id")


@query(MATCHES + f"SELECT pair_id, {sql_rnd('avg(x2) - avg(x1)')} AS tx, {sql_rnd('avg(y2) - avg(y1)')} AS ty, count(*) AS n FROM matches GROUP BY pair_id")
def fit_translation(spark, d):
    return G.fit_translation(matches(spark, d)).select("pair_id", rnd("tx").alias("tx"), rnd("ty").alias("ty"), "n")


RIGID = """rigid AS (SELECT pair_id, cos(a) AS c, sin(a) AS s, mx2 - cos(a) * mx1 + sin(a) * my1 AS tx, my2 - sin(a) * mx1 - cos(a) * my1 AS ty, n FROM
    (SELECT pair_id, mx1, my1, mx2, my2, count(*) AS n, atan2(sum((x1 - mx1) * (y2 - my2) - (y1 - my1) * (x2 - mx2)),
    sum((x1 - mx1) * (x2 - mx2) + (y1 - my1) * (y2 - my2))) AS a FROM matches JOIN (SELECT pair_id, avg(x1) AS mx1, avg(y1) AS my1, avg(x2) AS mx2, avg(y2) AS my2
    FROM matches GROUP BY 1) USING (pair_id) GROUP BY ALL)),
    errors AS (SELECT pair_id, match_id, sqrt(pow(c * x1 - s * y1 + tx - x2, 2) + pow(s * x1 + c * y1 + ty - y2, 2)) AS error FROM matches JOIN rigid USING (pair_id))"""


@query(MATCHES + ", " + RIGID + f" SELECT pair_id, {sql_rnd('c')} AS c, {sql_rnd('s')} AS s, {sql_rnd('tx')} AS tx, {sql_rnd('ty')} AS ty, n FROM rigid")
def fit_rigid(spark, d):
    m = G.fit_rigid(matches(spark, d))
    return m.select("pair_id", rnd("cos").alias("c"), rnd("sin").alias("s"), rnd("tx").alias("tx"), rnd("ty").alias("ty"), "n")


@query(MATCHES + ", " + RIGID + f" SELECT pair_id, match_id, {sql_rnd('c * x1 - s * y1 + tx')} AS x, {sql_rnd('s * x1 + c * y1 + ty')} AS y FROM matches JOIN rigid USING (pair_id)")
def apply_transform(spark, d):
    m = matches(spark, d)
    moved = G.apply_transform(G.source_points(m), G.fit_rigid(m))
    return moved.select("pair_id", "match_id", rnd("x").alias("x"), rnd("y").alias("y"))


@query(MATCHES + ", " + RIGID + f" SELECT pair_id, match_id, {sql_rnd('x1 + 0.25 * (c * x1 - s * y1 + tx - x1)')} AS x, {sql_rnd('y1 + 0.25 * (s * x1 + c * y1 + ty - y1)')} AS y FROM matches JOIN rigid USING (pair_id)")
def apply_transform_part(spark, d):
    """A quarter of the way."""
    m = matches(spark, d)
    moved = G.apply_transform(G.source_points(m), G.fit_rigid(m), 0.25)
    return moved.select("pair_id", "match_id", rnd("x").alias("x"), rnd("y").alias("y"))


@query(MATCHES + ", " + RIGID + f" SELECT pair_id, match_id, {sql_rnd('c * (x2 - tx) + s * (y2 - ty)')} AS x, {sql_rnd('c * (y2 - ty) - s * (x2 - tx)')} AS y FROM matches JOIN rigid USING (pair_id)")
def apply_inverse(spark, d):
    m = matches(spark, d)
    moved = G.apply_inverse(G.target_points(m), G.fit_rigid(m))
    return moved.select("pair_id", "match_id", rnd("x").alias("x"), rnd("y").alias("y"))


@query(MATCHES + ", " + RIGID + f" SELECT pair_id, match_id, {sql_rnd('error')} AS error FROM errors WHERE error < 300")
def threshold_inliers(spark, d):
    m = matches(spark, d)
    return G.threshold_inliers(m, G.fit_rigid(m), 300.0).select("pair_id", "match_id", rnd("error").alias("error"))


@query(MATCHES + ", " + RIGID + f""" SELECT pair_id, count(*) AS n, CAST(sum((error < 300)::INT) AS BIGINT) AS inliers, {sql_rnd('avg((error < 300)::INT)')} AS ratio,
    {sql_rnd('1 - avg((error < 300)::INT)')} AS cost, sum((error < 300)::INT) >= 10 AND avg((error < 300)::INT) > 0.3 AS good FROM errors GROUP BY pair_id""")
def score_model(spark, d):
    m = matches(spark, d)
    s = G.score_model(m, G.fit_rigid(m), 300.0, 0.3, 10)
    return s.select("pair_id", "n", "inliers", rnd("ratio").alias("ratio"), rnd("cost").alias("cost"), "good")


@query(MATCHES + ", " + RIGID + f""" SELECT pair_id, count(*) AS n, {sql_rnd('avg(error)')} AS mean, {sql_rnd('var_pop(error)', 4)} AS variance, {sql_rnd('stddev_pop(error)')} AS deviation,
    {sql_rnd('avg(error * error)', 4)} AS variance0, {sql_rnd('min(error)')} AS lowest, {sql_rnd('max(error)')} AS highest, {sql_rnd('median(error)')} AS median FROM errors GROUP BY pair_id""")
def error_statistics(spark, d):
    m = matches(spark, d)
    s = T.error_statistics(G.with_error(m, G.fit_rigid(m)), ["pair_id"], "error")
    return s.select(
        "pair_id", "n", *(rnd(c).alias(c) for c in ("mean", "deviation", "lowest", "highest", "median")),
        rnd("variance", 4).alias("variance"), rnd("variance0", 4).alias("variance0"),
    )


@query(MATCHES + f"SELECT pair_id, {sql_rnd('avg(d)')} AS mean_distance, {sql_rnd('max(d)')} AS max_distance FROM (SELECT pair_id, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS d FROM matches) GROUP BY 1")
def match_distance(spark, d):
    s = T.match_distance(matches(spark, d))
    return s.select("pair_id", rnd("mean_distance").alias("mean_distance"), rnd("max_distance").alias("max_distance"))


@query("SELECT event_id, value, " + sql_rnd("coalesce(value - lag(value) OVER (ORDER BY event_id), 0)") + " AS slope, "
       + sql_rnd("(value - lag(value, 5) OVER (ORDER BY event_id)) / 5") + " AS wide_slope FROM events")
def error_slope(spark, d):
    """Slopes of the event values along the event number."""
    series = table(spark, d, "events").select(F.lit(0).alias("series"), "event_id", "value")
    s = T.error_slope(series, ["series"], "event_id", "value", 5)
    return s.select("event_id", "value", rnd("slope").alias("slope"), rnd("wide_slope").alias("wide_slope"))


@query(PAIRS + "SELECT CAST(b AS INTEGER) AS bin, count(f.vec_id) AS n, " + sql_rnd("count(f.vec_id) / (SELECT count(*) FROM features)")
       + " AS share FROM range(64) t(b) LEFT JOIN features f ON b = greatest(0, least(63, CAST(trunc(ln(scale) / ln(2) * 28) AS INTEGER))) GROUP BY 1")
def feature_size_histogram(spark, d):
    return T.feature_size_histogram(features(spark, d), 64).select("bin", "n", rnd("share").alias("share"))


@query(MATCHES + f"SELECT pair_id, match_id, {sql_rnd('x2')} AS x1, {sql_rnd('y2')} AS y1, {sql_rnd('x1')} AS x2, {sql_rnd('y1')} AS y2 FROM matches")
def flip_matches(spark, d):
    m = G.flip_matches(matches(spark, d))
    return m.select("pair_id", "match_id", *(rnd(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(MATCHES + f"SELECT pair_id, match_id, {sql_rnd('x1')} AS x, {sql_rnd('y1')} AS y, 'source' AS side FROM matches UNION ALL SELECT pair_id, match_id, {sql_rnd('x2')}, {sql_rnd('y2')}, 'target' FROM matches")
def match_endpoints(spark, d):
    m = matches(spark, d)
    both = G.source_points(m).withColumn("side", F.lit("source")).unionByName(G.target_points(m).withColumn("side", F.lit("target")))
    return both.select("pair_id", "match_id", rnd("x").alias("x"), rnd("y").alias("y"), "side")


@query(MATCHES + f"SELECT pair_id, match_id, {sql_rnd('pow(x2 - x1, 2) + pow(y2 - y1, 2)', 4)} AS square, {sql_rnd('sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))')} AS distance FROM matches")
def point_distance(spark, d):
    m = G.point_distance(matches(spark, d))
    return m.select("pair_id", "match_id", rnd("square", 4).alias("square"), rnd("distance").alias("distance"))


def _models(m):
    return m.select("pair_id", *(rnd(c, 4).alias(c) for c in ("cos", "sin", "tx", "ty")))


TRUE_MODEL = MATCHES + f"SELECT DISTINCT pair_id, {sql_rnd('cos(pair_id * 0.01)', 2)} AS cos, {sql_rnd('sin(pair_id * 0.01)', 2)} AS sin FROM matches"


_A = "(pair_id * 0.01)"
FOUND_MODEL = MATCHES + f""", judged AS (SELECT *, sqrt(pow(cos{_A} * x1 - sin{_A} * y1 + pair_id - x2, 2)
    + pow(sin{_A} * x1 + cos{_A} * y1 - pair_id / 2 - y2, 2)) < 0.2 AS close FROM matches)
    SELECT pair_id, {sql_rnd(f'cos{_A}', 2)} AS cos, {sql_rnd(f'sin{_A}', 2)} AS sin, CAST(pair_id AS DOUBLE) AS tx, CAST(-pair_id AS DOUBLE) + 0.0 AS ty_twice,
    count(*) FILTER (close) AS inliers, {sql_rnd('1 - count(*) FILTER (close) / count(*)')} AS cost FROM judged GROUP BY pair_id"""


def _found(best):
    return best.select(
        "pair_id", rnd("cos", 2).alias("cos"), rnd("sin", 2).alias("sin"), rnd("tx", 0).alias("tx"), rnd(F.col("ty") * 2, 0).alias("ty_twice"),
        "inliers", rnd("cost").alias("cost"),
    )


@query(FOUND_MODEL)
def ransac(spark, d):
    """Rotation, shift and inliers of every pair in spite of a third outliers."""
    return _found(G.ransac(matches(spark, d), 60, 0.5, 0.1))


@query()
def ransac_translation(spark, d):
    """The best shift of every pair."""
    return _models(G.ransac(matches(spark, d), 60, 40.0, 0.01, kind="translation"))


@query(FOUND_MODEL)
def ransac_grow_epsilon(spark, d):
    """Tolerance raised until no more inliers appear."""
    return _found(G.ransac_grow_epsilon(matches(spark, d), 0.1, 1.0, 0.1))


def _trim_sql(trust: float, rounds: int = 20) -> str:
    """Fit, median, filter; rounds after the last match went change nothing."""
    ctes = ["m0 AS (SELECT * FROM matches)"]
    for at in range(rounds):
        ctes += [
            f"""f{at} AS (SELECT pair_id, cos(a) AS c, sin(a) AS s, x2 - cos(a) * x1 + sin(a) * y1 AS tx, y2 - sin(a) * x1 - cos(a) * y1 AS ty FROM
                (SELECT pair_id, avg(x1) AS x1, avg(y1) AS y1, avg(x2) AS x2, avg(y2) AS y2,
                atan2(covar_pop(x1, y2) - covar_pop(y1, x2), covar_pop(x1, x2) + covar_pop(y1, y2)) AS a FROM m{at} GROUP BY 1))""",
            f"""e{at} AS MATERIALIZED (SELECT m.*, sqrt(pow(c * x1 - s * y1 + tx - x2, 2) + pow(s * x1 + c * y1 + ty - y2, 2)) AS error FROM m{at} m JOIN f{at} USING (pair_id))""",
            f"""m{at + 1} AS MATERIALIZED (SELECT e.* EXCLUDE (error, mid) FROM (SELECT *, median(error) OVER (PARTITION BY pair_id) AS mid FROM e{at}) e WHERE error <= mid * {trust})""",
        ]
    return MATCHES + ", " + ",\n".join(ctes) + f" SELECT pair_id, count(*) AS n, count(*) AS kept, {sql_rnd('avg(error)')} AS mean_error FROM e{rounds - 1} GROUP BY 1"


@query(_trim_sql(3.0))
def trim_outliers(spark, d):
    """Matches kept and model after repeated trimming."""
    models, kept = G.trim_outliers(matches(spark, d), 3.0)
    counts = kept.groupBy("pair_id").agg(F.count("*").alias("kept"))
    return models.join(counts, "pair_id").select("pair_id", "n", "kept", rnd("mean_error").alias("mean_error"))


@query(TRUE_MODEL)
def ransac_trim(spark, d):
    """Random sampling, then trimming."""
    models, _ = G.ransac_trim(matches(spark, d), 60, 0.5, 0.1)
    return models.select("pair_id", rnd("cos", 2).alias("cos"), rnd("sin", 2).alias("sin"))


@query()
def icp(spark, d):
    """Point clouds aligned by nearest points."""
    models, found = G.icp(*_clouds(spark, d))
    counts = found.groupBy("pair_id").agg(F.count("*").alias("n_matches"))
    return _models(models).join(counts, "pair_id")


@query()
def local_smoothness_filter(spark, d):
    """Matches that agree with their surroundings."""
    kept = G.local_smoothness_filter(matches(spark, d), 200.0, 100.0, 3.0)
    return kept.groupBy("pair_id").agg(F.count("*").alias("kept"))
