"""Descriptors, codebooks and code maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, scratch, sql_rnd
from topiclens.catalog.standins import code_table, features, patches, with_sql
from topiclens.functions import scalars as S
from topiclens.operators import codebook as B
from topiclens.sinks.writers import dump_text, show_patches
from topiclens.sources.text import read_code_map_text

HEX = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


def _draw(seed):
    return HEX.format(f"CAST(vec_id AS VARCHAR) || ':{seed}'")


@query(with_sql("patches") + "SELECT vec_id, image_id || ' ' || x || ' ' || y AS name, image_id, x, y FROM patches")
def patch_names(spark, d):
    """Names packed and parsed again."""
    named = patches(spark, d).select("vec_id", S.patch_name("image_id", "x", "y").alias("name"))
    return named.select("vec_id", "name", S.parse_patch_name("name").alias("p")).select("vec_id", "name", "p.*")


@query(with_sql("patches") + "SELECT a.vec_id, " + sql_rnd(
    'sqrt(list_sum(list_transform(list_zip(a."desc", b."desc"), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))')
    + " AS distance FROM patches a JOIN patches b ON b.vec_id = a.vec_id + 1")
def descriptor_distance(spark, d):
    """Distance of every descriptor to the next one."""
    p = patches(spark, d)
    after = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("desc").alias("other"))
    return p.join(after, "vec_id").select("vec_id", rnd(S.euclidean("desc", "other")).alias("distance"))


L2 = "sqrt(list_sum(list_transform(\"desc\", lambda e: e * e)))"


@query(with_sql("patches") + f"""SELECT vec_id, CAST(i AS INTEGER) AS i, {sql_rnd('l2[i + 1]')} AS l2, {sql_rnd('mx[i + 1]')} AS mx
    FROM (SELECT vec_id, list_transform("desc", lambda e: least(1.0, e / {L2})) AS l2,
    list_transform("desc", lambda e: least(1.0, e / (list_max("desc") / 0.2))) AS mx FROM patches), range(64) t(i)""")
def descriptor_normalisation(spark, d):
    """Both normalisations of every descriptor entry."""
    p = patches(spark, d).select("vec_id", F.arrays_zip(S.normalize_l2("desc").alias("l2"), S.normalize_max("desc").alias("mx")).alias("n"))
    cells = p.select("vec_id", F.posexplode("n").alias("i", "e"))
    return cells.select("vec_id", "i", rnd("e.l2").alias("l2"), rnd("e.mx").alias("mx"))


@query(with_sql("patches", "centers", "assigned") + "SELECT vec_id, code, " + sql_rnd("dist") + " AS dist FROM assigned")
def assign_clusters(spark, d):
    assigned, _ = code_table(spark, d)
    return assigned.select("vec_id", "code", rnd("dist").alias("dist"))


@query(with_sql("patches", "centers", "assigned") + "SELECT image_id, x, y, code FROM assigned")
def apply_codebook(spark, d):
    """Assignment with given centres, as code positions."""
    p = patches(spark, d)
    _, centers = code_table(spark, d)
    return B.apply_codebook(p, centers, ["vec_id"]).select("image_id", "x", "y", "code")


CENTER_ROWS = """SELECT code, CAST(i AS INTEGER) AS i, """ + sql_rnd("avg(\"desc\"[i + 1])") + """ AS value, count(*) AS n
    FROM assigned, range(64) t(i) GROUP BY code, i"""


@query(with_sql("patches", "centers", "assigned") + CENTER_ROWS)
def update_centers(spark, d):
    """One Lloyd round: new centres and cluster sizes."""
    assigned, _ = code_table(spark, d)
    cells = B.update_centers(assigned).select("code", "n", F.posexplode("center").alias("i", "value"))
    return cells.select("code", "i", rnd("value").alias("value"), "n")


@query(with_sql("patches") + f"""SELECT CAST(code AS INTEGER) AS code, vec_id, {sql_rnd('"desc"[1]')} AS head FROM (SELECT *,
    row_number() OVER (ORDER BY {_draw(7)}, vec_id) AS code FROM patches) WHERE code <= 16""")
def seed_centers(spark, d):
    """Sixteen random rows as first centres."""
    seeds = B.seed_centers(patches(spark, d), 16, "vec_id", seed=7)
    return seeds.select("code", "seed_id", "center").select("code", F.col("seed_id").alias("vec_id"), rnd(F.col("center")[0]).alias("head"))


@query(with_sql("patches") + """SELECT CAST(row_number() OVER (ORDER BY label DESC) AS INTEGER) AS code, label AS seed_id
    FROM (SELECT DISTINCT label FROM patches)""")
def renumber_clusters(spark, d):
    """Clusters keyed by falling label, renumbered from 1."""
    p = patches(spark, d).select("label").distinct().select(F.col("label").alias("seed_id"), (-F.col("label")).alias("at"))
    return B.renumber_clusters(p, "at").select("code", "seed_id")


@query(with_sql("patches") + f"SELECT vec_id FROM patches WHERE {_draw(3)} < 0.3 * 4294967296")
def sample_rows(spark, d):
    return B.sample_rows(patches(spark, d), 0.3, ["vec_id"], seed=3).select("vec_id")


@query(with_sql("patches") + f"SELECT vec_id, row_number() OVER (ORDER BY {_draw(5)}, vec_id) AS place FROM patches")
def shuffle_rows(spark, d):
    """Random order of all rows, with each row's place."""
    from topiclens.spread import number_rows

    p = patches(spark, d).select("vec_id")
    return number_rows(p, [S.draw("vec_id", F.lit(5)), F.col("vec_id")], "place")


@query()
def build_codebook(spark, d):
    """K-means centres and the clusters' sizes."""
    p = patches(spark, d)
    centers = B.build_codebook(p, k=16, seed=1)
    return B.assign_clusters(p, centers, ["vec_id"]).groupBy("code").agg(F.count("*").alias("n"), rnd(F.avg("dist")).alias("mean_dist"))


@query()
def build_codebook_sampled(spark, d):
    """K-means on a sample, all rows assigned."""
    _, assigned = B.build_codebook_sampled(patches(spark, d), 0.5, ["vec_id"], k=16, seed=1)
    return assigned.select("image_id", "x", "y", "code", rnd("dist").alias("dist"))


@query(with_sql("patches", "centers", "assigned") + """, c2 AS (SELECT code, list(v ORDER BY i) AS center FROM
    (SELECT code, i, avg("desc"[i + 1]) AS v FROM assigned, range(64) t(i) GROUP BY code, i) GROUP BY code),
    d2 AS (SELECT p.vec_id, c.code, list_sum(list_transform(list_zip(p."desc", c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM patches p, c2 c) SELECT vec_id, arg_min(code, (d, code)) AS code FROM d2 GROUP BY vec_id""")
def lloyd_rounds(spark, d):
    """Codes after one full Lloyd round from given centres."""
    p = patches(spark, d)
    _, centers = code_table(spark, d)
    moved = B.lloyd_codebook(p, centers, ["vec_id"], max_iter=1)
    return B.assign_clusters(p, moved, ["vec_id"]).select("vec_id", "code")


def _lloyd_sql(rounds: int) -> str:
    """Rounds of assignment and means from the given centres; a centre without points stays."""
    away = 'list_sum(list_transform(list_zip(p."desc", c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))'
    ctes = ["c0 AS (SELECT code, center FROM centers)"]
    for at in range(rounds):
        ctes += [
            f"a{at} AS MATERIALIZED (SELECT p.vec_id, arg_min(c.code, ({away}, c.code)) AS code FROM patches p, c{at} c GROUP BY 1)",
            f"""m{at} AS (SELECT code, list(v ORDER BY i) AS center FROM (SELECT code, i, avg("desc"[i]) AS v FROM patches JOIN a{at} USING (vec_id), range(1, 65) t(i)
                GROUP BY code, i) GROUP BY code)""",
            f"c{at + 1} AS MATERIALIZED (SELECT c.code, coalesce(m.center, c.center) AS center FROM c{at} c LEFT JOIN m{at} m USING (code))",
        ]
    return with_sql("patches", "centers") + ", " + ",\n".join(ctes) + f""" SELECT vec_id, code, {sql_rnd('sqrt(d)', 4)} AS dist FROM (SELECT p.vec_id, arg_min(c.code, ({away}, c.code)) AS code,
        min({away}) AS d FROM patches p, c{rounds} c GROUP BY 1)"""


@query(_lloyd_sql(40))
def lloyd_codebook(spark, d):
    """Codes under the codebook that forty Lloyd rounds, or fewer if it settles, make of the given centres."""
    p = patches(spark, d)
    _, centers = code_table(spark, d)
    made = B.lloyd_codebook(p, centers, ["vec_id"], max_iter=40, tol=0.0)
    return B.assign_clusters(p, made, ["vec_id"]).select("vec_id", "code", rnd("dist", 4).alias("dist"))


@query(with_sql("patches", "centers", "assigned") + """SELECT code, CAST(0 AS INTEGER) AS part, string_agg(image_id || ' ' || x || ' ' || y, ','
    ORDER BY image_id || ' ' || x || ' ' || y) AS members, count(*) AS n FROM assigned GROUP BY code""")
def cluster_members(spark, d):
    assigned, _ = code_table(spark, d)
    listed = B.cluster_members(assigned, B.member_name())
    return listed.select("code", "part", F.array_join("members", ",").alias("members"), "n")


@query()
def cluster_report(spark, d):
    """Vectors to members per cluster."""
    report = B.cluster_report(patches(spark, d), 8, ["vec_id"], B.member_name(), seed=2)
    return report.select("code", "part", F.array_join("members", ",").alias("members"), "n")


@query(with_sql("patches", "centers", "assigned") + "SELECT image_id, code, count(*) AS n FROM assigned GROUP BY image_id, code")
def bag_of_codes(spark, d):
    from topiclens.operators.corpus import bag_of_codes as bag

    return bag(code_table(spark, d)[0])


@query(with_sql("patches", "centers", "assigned") + """SELECT image_id, CAST(0 AS INTEGER) AS part,
    '{' || string_agg('(' || x || ', ' || y || ')=' || code, ', ' ORDER BY x, y) || '}' AS patches FROM assigned GROUP BY image_id""")
def code_maps(spark, d):
    """Every image as one map from position to code."""
    maps = B.collect_code_map(B.last_code(code_table(spark, d)[0], "vec_id"))
    return maps.select("image_id", "part", show_patches(F.col("patches")).alias("patches"))


@query(with_sql("patches", "centers", "assigned") + "SELECT image_id, x, y, code FROM assigned")
def explode_code_maps(spark, d):
    return B.explode_codes(B.collect_code_map(code_table(spark, d)[0]))


@query(with_sql("patches", "centers", "assigned") + "SELECT image_id, x, y, code FROM assigned")
def code_map_text(spark, d):
    """Code maps dumped as text and parsed back."""
    path = scratch(spark, "codemaps")
    maps = B.collect_code_map(code_table(spark, d)[0])
    dump_text(maps, "image_id", show_patches(F.col("patches")), path)
    return read_code_map_text(spark, path)


@query(with_sql("features") + """SELECT CAST(row_number() OVER (ORDER BY scale DESC, image_id, x, y) AS BIGINT) AS place, vec_id FROM features""")
def sort_features(spark, d):
    """Features by falling scale, with each one's place."""
    from topiclens.spread import number_rows

    f = features(spark, d).select("vec_id", "scale", "image_id", "x", "y")
    return number_rows(f, [F.desc("scale"), F.col("image_id"), F.col("x"), F.col("y")], "place").select("place", "vec_id")
