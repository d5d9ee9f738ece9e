"""Pixel tables: gradients, blurs, kernels, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, sql_rnd
from topiclens.catalog.standins import mosaic_sizes, pixels, rgb_pixels, table, with_sql
from topiclens.functions.kernels import gaussian_1d
from topiclens.operators import pixels as P

PX = with_sql("pixels")
WX = "OVER (PARTITION BY image_id, y ORDER BY x)"
WY = "OVER (PARTITION BY image_id, x ORDER BY y)"


def _r(df, *columns, places=6):
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, *(rnd(c, places).alias(c) for c in columns))


@query(PX + f"""SELECT image_id, x, y, {sql_rnd('dx')} AS dx, {sql_rnd('dy')} AS dy, {sql_rnd('sqrt(dx * dx + dy * dy)')} AS magnitude,
    {sql_rnd('atan2(dy, dx)')} AS direction FROM (SELECT image_id, x, y, (lead(v, 1, v) {WX} - lag(v, 1, v) {WX}) / 2 AS dx,
    (lead(v, 1, v) {WY} - lag(v, 1, v) {WY}) / 2 AS dy FROM pixels)""")
def pixel_gradients(spark, d):
    return _r(P.pixel_gradients(pixels(spark, d)), "dx", "dy", "magnitude", "direction")


def _laplace_sql(r):
    second = lambda w: f"(lag(v, {r}) {w} - 2 * v + lead(v, {r}) {w})"
    return PX + f"""SELECT image_id, x, y, {sql_rnd('coalesce(sqrt(a * a + b * b), 0)')} AS v
        FROM (SELECT image_id, x, y, {second(WX)} AS a, {second(WY)} AS b FROM pixels)"""


@query(_laplace_sql(1))
def laplace(spark, d):
    return _r(P.laplace(pixels(spark, d), 1), "v")


@query(_laplace_sql(2))
def laplace_wide(spark, d):
    return _r(P.laplace(pixels(spark, d), 2), "v")


@query(PX + f"SELECT image_id, {sql_rnd('min(v)')} AS lo, {sql_rnd('max(v)')} AS hi FROM pixels GROUP BY image_id")
def pixel_extent(spark, d):
    return _r(P.pixel_extent(pixels(spark, d)), "lo", "hi")


EXTENT = "extent AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY image_id)"


@query(PX + ", " + EXTENT + f" SELECT image_id, x, y, {sql_rnd('255 * (v - lo) / (hi - lo)')} AS v FROM pixels JOIN extent USING (image_id)")
def enhance(spark, d):
    return _r(P.enhance(pixels(spark, d), 255.0), "v")


@query(PX + ", " + EXTENT + f" SELECT image_id, x, y, {sql_rnd('(v - lo / 2) / (hi / 2 - lo / 2)')} AS v FROM pixels JOIN extent USING (image_id)")
def crop_normalize(spark, d):
    """Limits at half the extent: values outside 0..1 stay."""
    p = P.with_extent(pixels(spark, d)).withColumn("lo", F.col("lo") / 2).withColumn("hi", F.col("hi") / 2)
    return _r(P.crop_normalize(p), "v")


@query(PX + f"SELECT image_id, x, y, {sql_rnd('greatest(0.0, least(255.0, v * 1000))')} AS v FROM pixels")
def clamp_to_byte(spark, d):
    p = pixels(spark, d).withColumn("v", F.col("v") * 1000)
    return _r(P.normalize_to_byte(p, True), "v")


@query(PX + """, big AS (SELECT image_id, x, y, v * 1000 AS v FROM pixels), e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM big GROUP BY 1)
    SELECT image_id, x, y, CASE WHEN hi > 255 OR lo < 0 THEN trunc((v - lo) / ((hi - lo) / 255.0)) ELSE v END AS v FROM big JOIN e USING (image_id)""")
def rescale_to_byte(spark, d):
    return P.normalize_to_byte(pixels(spark, d).withColumn("v", F.col("v") * 1000), False)


@query(PX.rstrip() + """, sg AS (SELECT DISTINCT (label + 1) * 0.3 AS sigma FROM embeddings), k AS (SELECT sigma, CAST(dx AS INTEGER) AS dx,
    exp(-(dx * dx) / (2 * sigma * sigma)) AS w FROM (SELECT sigma, unnest(range(-h, h + 1)) AS dx FROM
    (SELECT sigma, greatest(1, CAST(trunc(3 * sigma + 0.5) AS INTEGER)) AS h FROM sg)))
    SELECT """ + sql_rnd("sigma") + " AS sigma, dx, " + sql_rnd("w / sum(w) OVER (PARTITION BY sigma)") + " AS w FROM k")
def gaussian_kernel(spark, d):
    """Kernels of the blurs given by the labels of the vectors."""
    sigmas = table(spark, d, "embeddings").select(((F.col("label") + 1) * 0.3).alias("s"))
    return _r(P.gaussian_kernel_rows(sigmas, "s"), "sigma", "w")


@query(PX.rstrip() + """, sg AS (SELECT DISTINCT (label + 1) * 0.3 AS sigma, label * 0.05 AS ox, 0.5 - label * 0.05 AS oy FROM embeddings),
    h AS (SELECT *, greatest(1, CAST(floor(3 * sigma + 0.5) AS INTEGER)) AS r FROM sg),
    k AS (SELECT sigma, ox, oy, dx, dy, exp(-((dx - ox) * (dx - ox) + (dy - oy) * (dy - oy)) / (2 * sigma * sigma)) AS w
    FROM (SELECT *, unnest(range(-r, r + 1)) AS dy FROM (SELECT *, unnest(range(-r, r + 1)) AS dx FROM h)))
    SELECT """ + sql_rnd("sigma") + " AS sigma, " + sql_rnd("ox") + " AS ox, " + sql_rnd("oy") + """ AS oy, CAST(dx AS INTEGER) AS dx,
    CAST(dy AS INTEGER) AS dy, """ + sql_rnd("w / sum(w) OVER (PARTITION BY sigma, ox, oy)") + " AS w FROM k")
def gaussian_kernel_shifted(spark, d):
    """2-D kernels with a sub-pixel shift."""
    sigmas = table(spark, d, "embeddings").select(
        ((F.col("label") + 1) * 0.3).alias("s"), (F.col("label") * 0.05).alias("a"), (0.5 - F.col("label") * 0.05).alias("b")
    )
    return _r(P.gaussian_kernel_2d_rows(sigmas, "s", "a", "b"), "sigma", "ox", "oy", "w")


MIRROR = "CASE WHEN ({0} % 16 + 16) % 16 < 8 THEN ({0} % 16 + 16) % 16 ELSE 15 - ({0} % 16 + 16) % 16 END"
INNER = "CASE WHEN ({0} % 14 + 14) % 14 <= 7 THEN ({0} % 14 + 14) % 14 ELSE 14 - ({0} % 14 + 14) % 14 END"


def _two_pass(sigma, source, edge):
    """SQL of two 1-D passes over 8 x 8 images; ``source`` maps a target index to its sample."""
    half = len(gaussian_1d(sigma)) // 2
    base = f"kernel AS (SELECT o, w / sum(w) OVER () AS w FROM (SELECT o, exp(-(o * o) / {2.0 * sigma * sigma}) AS w FROM range({-half}, {half + 1}) t(o)))"
    where = "" if source else "WHERE {0} + o BETWEEN 0 AND 7"
    value = "sum(w * s.v) / sum(w)" if edge == "renorm" else "sum(w * s.v)"
    at = lambda c: source.format(f"(p.{c} + o)") if source else f"p.{c} + o"
    return PX + f""", {base},
        px AS (SELECT p.image_id, p.x, p.y, {value} AS v FROM pixels p, kernel JOIN pixels s ON s.image_id = p.image_id AND s.y = p.y AND s.x = {at('x')}
        {where.format('p.x')} GROUP BY 1, 2, 3),
        py AS (SELECT p.image_id, p.x, p.y, {value} AS v FROM px p, kernel JOIN px s ON s.image_id = p.image_id AND s.x = p.x AND s.y = {at('y')}
        {where.format('p.y')} GROUP BY 1, 2, 3)
        SELECT image_id, x, y, {sql_rnd('v')} AS v FROM py"""


@query(_two_pass(1.1, MIRROR, "mirror"))
def separable_convolve(spark, d):
    """Two passes repeating edge samples."""
    return _r(P.separable_convolve(pixels(spark, d), gaussian_1d(1.1)), "v")


@query(_two_pass(1.3, None, "renorm"))
def gaussian_blur(spark, d):
    return _r(P.gaussian_blur(pixels(spark, d), 1.3), "v")


@query(_two_pass(1.2, INNER, "inner"))
def gaussian_blur_mirror(spark, d):
    return _r(P.gaussian_blur_mirror(pixels(spark, d), 1.2), "v")


@query(PX + f""", cols AS (SELECT x AS c, 0.5 + 1.5 / 8 * x AS sigma FROM range(8) t(x)), r AS (SELECT *, greatest(1, CAST(trunc(3 * sigma + 0.5) AS INTEGER)) AS h FROM cols),
    kernel AS (SELECT c, o, w / sum(w) OVER (PARTITION BY c) AS w FROM (SELECT c, o, exp(-(o * o) / (2 * sigma * sigma)) AS w FROM (SELECT *, unnest(range(-h, h + 1)) AS o FROM r)))
    SELECT p.image_id, p.x, p.y, {sql_rnd('sum(a.w * b.w * s.v)')} AS v FROM pixels p JOIN kernel a ON a.c = p.x JOIN kernel b ON b.c = p.x
    JOIN pixels s ON s.image_id = p.image_id AND s.x = p.x + a.o AND s.y = p.y + b.o GROUP BY 1, 2, 3""")
def gaussian_blur_ramp(spark, d):
    """Blur growing from left to right."""
    return _r(P.gaussian_blur_ramp_x(pixels(spark, d), 0.5, 2.0), "v")


def _jitter_sql(axis):
    w = WX if axis == "x" else WY
    return PX + f""", r AS (SELECT *, (CAST(('0x' || substr(md5('11:' || {axis}), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5) * 2 AS r,
        lag(v, 1, 0.0) {w} AS a, lead(v, 1, 0.0) {w} AS b FROM pixels)
        SELECT image_id, x, y, {sql_rnd('CASE WHEN r < 0 THEN -r * a + (1 + r) * v ELSE (1 - r) * v + r * b END')} AS v FROM r"""


@query(_jitter_sql("x"))
def jitter_columns(spark, d):
    return _r(P.jitter_resample(pixels(spark, d), "x", 11), "v")


@query(_jitter_sql("y"))
def jitter_rows(spark, d):
    return _r(P.jitter_resample(pixels(spark, d), "y", 11), "v")


@query(PX + f"SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {sql_rnd('v')} AS v FROM pixels WHERE x % 2 = 0 AND y % 2 = 0")
def downsample2(spark, d):
    return _r(P.downsample2(pixels(spark, d)), "v")


@query(PX + f"""SELECT a.image_id, CAST(2 * a.x + dx AS INTEGER) AS x, CAST(2 * a.y + dy AS INTEGER) AS y, {sql_rnd('(a.v + b.v) / 2')} AS v
    FROM (SELECT image_id, x, y, v, dx, dy, x + dx AS bx, y + dy AS b_y FROM pixels, range(2) s(dx), range(2) t(dy)) a
    JOIN pixels b ON b.image_id = a.image_id AND b.x = a.bx AND b.y = a.b_y""")
def upsample2(spark, d):
    return _r(P.upsample2(pixels(spark, d)), "v")


def _grid_sql(start, margin):
    return f"""WITH s AS (SELECT DISTINCT CAST(vec_id // 20 AS INTEGER) AS image_id FROM embeddings)
        SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM s, range({start}, 40 - {margin}, 8) a(x), range({start}, 32 - {margin}, 8) b(y)"""


@query(_grid_sql(4, 0))
def grid_half_step(spark, d):
    return P.grid_points(mosaic_sizes(spark, d), 8, "half_step")


@query(_grid_sql(8, 8))
def grid_inside(spark, d):
    return P.grid_points(mosaic_sizes(spark, d), 8, "inside")


@query(_grid_sql(8, 0))
def grid_half_block(spark, d):
    return P.grid_points(mosaic_sizes(spark, d), 8, "half_block")


@query(with_sql("pixels", "rgb") + "SELECT image_id, x, y, " + sql_rnd("0.3 * ((rgb >> 16) & 255) + 0.6 * ((rgb >> 8) & 255) + 0.1 * (rgb & 255)") + " AS v FROM rgb")
def pixel_luma(spark, d):
    return _r(P.pixel_luma(rgb_pixels(spark, d)), "v")
