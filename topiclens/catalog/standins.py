"""Working tables of the operators, derived in Spark from whole input tables.

Each has a SQL twin in ``SQL`` so that queries can be checked on another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.functions.scalars import pack_rgb
from topiclens.operators.corpus import bag_of_words
from topiclens.operators.images import assemble_images
from topiclens.sources.tables import read_table
from topiclens.spread import largest_group

PALETTE = [  # fixed values: the 14 class colours of the ground truth, void first
    (0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128),
    (128, 128, 128), (64, 0, 0), (192, 0, 0), (64, 128, 0), (192, 128, 0), (64, 0, 128), (192, 0, 128),
]
TITLE_ROWS = 1000  # rows of a title that one task counts
SPLIT_PARTS = 16  # a split of the documents' file has 128 MB as a rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spread_by = {"documents": "doc_id", "conversations": "conv_id"}.get(name)
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread_by)


def bag(spark, sf_dir) -> DataFrame:
    """Words of the documents; the title is the document number as text.

    Whole texts are dealt by title, so that their words are counted where they are: (title, term)
    pairs take three times the room, and of a large split do not fit a task's memory. Should a
    title stand in very many rows, its words are counted in all splits and then added up.
    """
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("title"), "text")
    if largest_group(docs, ["title"]) > TITLE_ROWS:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
        return bag_of_words(docs, "title")
    parts = max(spark.sparkContext.defaultParallelism, SPLIT_PARTS * docs.rdd.getNumPartitions())
    return bag_of_words(docs.repartition(parts, "title"), "title")


def order_bag(spark, sf_dir) -> DataFrame:
    """Parts in orders: order = document, part = term, quantity = count."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_orderkey").alias("doc_no"), F.col("l_partkey").alias("term")).agg(
        F.sum("l_quantity").cast("long").alias("n")
    )


def patches(spark, sf_dir) -> DataFrame:
    """20 descriptors per image on a 5 x 4 grid, step 8."""
    k = F.expr("cast(pmod(vec_id, 20) as int)")
    return table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id div 20 as int)").alias("image_id"),
        (F.lit(4) + (k % 5) * 8).alias("x"),
        (F.lit(4) + F.expr("cast(cast(pmod(vec_id, 20) as int) div 5 as int)") * 8).alias("y"),
        F.col("embedding").cast("array<double>").alias("desc"),
        "vec_id",
        "label",
    )


def pixels(spark, sf_dir) -> DataFrame:
    """One 8 x 8 image per vector."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v")
    )
    return cells.select(
        "image_id", (F.col("pos") % 8).alias("x"), F.expr("cast(pos div 8 as int)").alias("y"), F.col("v").cast("double").alias("v")
    )


def rgb_pixels(spark, sf_dir) -> DataFrame:
    """Coloured pixels: three different readings of the value as 0..255 channels."""
    spread = lambda a, b: F.pmod(F.floor((F.col("v") + 1) * a), F.lit(b)).cast("int")
    return pixels(spark, sf_dir).select(
        "image_id", "x", "y", pack_rgb(spread(64, 256), spread(32, 256), spread(16, 256)).alias("rgb")
    )


def mosaics(spark, sf_dir) -> DataFrame:
    """40 x 32 images of 20 tiles each, as image rows; the tile positions match ``patches``."""
    tiles = patches(spark, sf_dir).select("image_id", "x", "y", F.posexplode("desc").alias("pos", "v"))
    cells = tiles.select(
        "image_id", (F.col("x") - 4 + F.col("pos") % 8).alias("x"),
        (F.col("y") - 4 + F.expr("cast(pos div 8 as int)")).alias("y"), "v",
    )
    return spread_images(assemble_images(cells, mosaic_sizes(spark, sf_dir), "v", 0.0))


def spread_images(images: DataFrame) -> DataFrame:
    """Images over all cores: few bytes each, but much work."""
    return images.repartition(images.sparkSession.sparkContext.defaultParallelism, "image_id")


def mosaic_sizes(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 20 as int)").alias("image_id")).distinct()
    return ids.select("image_id", F.lit(40).alias("width"), F.lit(32).alias("height"))


def large_mosaics(spark, sf_dir) -> DataFrame:
    """80 x 80 images: 100 tiles each, smooth enough for key points."""
    tiles = table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id div 100 as int)").alias("image_id"),
        F.expr("cast(pmod(vec_id, 100) as int)").alias("k"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"),
    )
    cells = tiles.select(
        "image_id", (F.expr("k % 10") * 8 + F.col("pos") % 8).alias("x"),
        (F.expr("cast(k div 10 as int)") * 8 + F.expr("cast(pos div 8 as int)")).alias("y"), "v",
    )
    sizes = tiles.select("image_id").distinct().select("image_id", F.lit(80).alias("width"), F.lit(80).alias("height"))
    return spread_images(assemble_images(cells, sizes, "v", 0.0))


def phi(spark, sf_dir) -> DataFrame:
    """Topic probabilities: the softmax of ten times each vector; image = document."""
    v = F.transform(F.col("embedding"), lambda e: e.cast("double") * 10)
    norm = F.log(F.aggregate("v", F.lit(0.0), lambda s, e: s + F.exp(e)))
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("v", v)
        .withColumn("z", norm)
        .select(
            F.expr("vec_id div 20").alias("doc_no"),
            F.expr("cast(pmod(vec_id, 20) as int) + 1").alias("term_id"),
            (F.col("label") + 1).alias("n"),
            F.transform("v", lambda e: e - F.col("z")).alias("log_phi"),
        )
    )


def line_stats(spark, sf_dir) -> DataFrame:
    """Topic-term statistics from order lines: line number = topic, part = term."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_linenumber").alias("topic"), F.col("l_partkey").alias("term_id")).agg(
        F.log(F.sum("l_quantity")).alias("log_stat")
    )


def part_terms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"))


def matches(spark, sf_dir) -> DataFrame:
    """Point matches from orders: 50 pairs, a rotation and shift per pair, a third outliers."""
    base = table(spark, sf_dir, "orders").select(
        F.expr("pmod(o_custkey, 50)").alias("pair_id"),
        F.col("o_orderkey").alias("match_id"),
        (F.col("o_totalprice") / 1000).alias("x1"),
        F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("y1"),
        ((F.col("o_orderkey") % 7 - 3) / 100).alias("noise"),
        (F.col("o_orderstatus") == "P").alias("off"),
    )
    a = F.col("pair_id") * 0.01
    x2 = F.cos(a) * F.col("x1") - F.sin(a) * F.col("y1") + F.col("pair_id") + F.col("noise")
    y2 = F.sin(a) * F.col("x1") + F.cos(a) * F.col("y1") - F.col("pair_id") / 2 - F.col("noise")
    return base.select(
        "pair_id", "match_id", "x1", "y1",
        F.when(F.col("off"), F.col("y1") / 5).otherwise(x2).alias("x2"),
        F.when(F.col("off"), F.col("x1")).otherwise(y2).alias("y2"),
    )


def features(spark, sf_dir) -> DataFrame:
    """Features with a scale: descriptors of ``patches``."""
    return patches(spark, sf_dir).select(
        F.col("image_id").cast("long").alias("image_id"), "vec_id", (1.5 + F.col("label") * 0.25).alias("scale"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "desc",
    )


def feature_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every image against the next one."""
    f = features(spark, sf_dir)
    queries = f.select(F.col("image_id").alias("pair_id"), F.col("vec_id").alias("query_id"), "scale", "x", "y", "desc")
    targets = f.select((F.col("image_id") - 1).alias("pair_id"), F.col("vec_id").alias("target_id"), "scale", "x", "y", "desc")
    return queries, targets


def painted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Predicted labels and truth as patches with an order: (label from the vector, given label)."""
    p = patches(spark, sf_dir)
    top = F.array_position("desc", F.array_max("desc"))
    predicted = p.select("image_id", "x", "y", (F.pmod(top, F.lit(9)) + 1).cast("int").alias("label"), F.col("vec_id").alias("ordinal"))
    truth = p.select("image_id", "x", "y", (F.col("label") + 1).alias("label"), F.col("vec_id").alias("ordinal"))
    return predicted, truth


SQL = {
    "bag": r"""bag AS (SELECT title, term, count(*) AS n FROM (
        SELECT CAST(doc_id AS VARCHAR) AS title, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS term FROM documents)
        WHERE term <> '' GROUP BY title, term)""",
    "order_bag": """order_bag AS (SELECT l_orderkey AS doc_no, l_partkey AS term, CAST(sum(l_quantity) AS BIGINT) AS n
        FROM lineitem GROUP BY 1, 2)""",
    "patches": """patches AS (SELECT CAST(vec_id // 20 AS INTEGER) AS image_id,
        CAST(4 + 8 * ((vec_id % 20) % 5) AS INTEGER) AS x, CAST(4 + 8 * ((vec_id % 20) // 5) AS INTEGER) AS y,
        CAST(embedding AS DOUBLE[]) AS "desc", vec_id, label FROM embeddings)""",
    "pixels": """pixels AS (SELECT vec_id AS image_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
        CAST(embedding[pos + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(pos))""",
    "rgb": """rgb AS (SELECT image_id, x, y,
        (CAST(floor((v + 1) * 64) AS INTEGER) % 256) * 65536 + (CAST(floor((v + 1) * 32) AS INTEGER) % 256) * 256
        + (CAST(floor((v + 1) * 16) AS INTEGER) % 256) AS rgb FROM pixels)""",
    "phi": """phi AS (SELECT vec_id // 20 AS doc_no, CAST(vec_id % 20 AS INTEGER) + 1 AS term_id, label + 1 AS n,
        list_transform(v, lambda e: e - z) AS log_phi FROM (SELECT *, ln(list_sum(list_transform(v, lambda e: exp(e)))) AS z
        FROM (SELECT *, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 10) AS v FROM embeddings)))""",
    "line_stats": """line_stats AS (SELECT l_linenumber AS topic, l_partkey AS term_id, ln(sum(l_quantity)) AS log_stat
        FROM lineitem GROUP BY 1, 2)""",
    "matches": """matches AS (SELECT pair_id, match_id, x1, y1,
        CASE WHEN off THEN y1 / 5 ELSE cos(pair_id * 0.01) * x1 - sin(pair_id * 0.01) * y1 + pair_id + noise END AS x2,
        CASE WHEN off THEN x1 ELSE sin(pair_id * 0.01) * x1 + cos(pair_id * 0.01) * y1 - pair_id / 2 - noise END AS y2
        FROM (SELECT o_custkey % 50 AS pair_id, o_orderkey AS match_id, o_totalprice / 1000 AS x1,
        CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y1,
        (o_orderkey % 7 - 3) / 100 AS noise, o_orderstatus = 'P' AS off FROM orders))""",
    "features": """features AS (SELECT CAST(vec_id // 20 AS BIGINT) AS image_id, vec_id, CAST(1.5 + label * 0.25 AS DOUBLE) AS scale,
        CAST(4 + 8 * ((vec_id % 20) % 5) AS DOUBLE) AS x, CAST(4 + 8 * ((vec_id % 20) // 5) AS DOUBLE) AS y,
        CAST(embedding AS DOUBLE[]) AS "desc" FROM embeddings)""",
    "candidates": """candidates AS (SELECT a.image_id AS pair_id, a.vec_id AS query_id, b.vec_id AS target_id,
        a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.scale AS s1, b.scale AS s2,
        sqrt(list_sum(list_transform(list_zip(a."desc", b."desc"), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
        FROM features a JOIN features b ON b.image_id = a.image_id + 1)""",
    "painted": """painted AS (SELECT image_id, x, y, CAST(list_position("desc", list_max("desc")) % 9 + 1 AS INTEGER) AS label,
        label + 1 AS truth, vec_id AS ordinal FROM patches)""",
    "canvas": """spots AS (SELECT image_id, x + dx AS x, y + dy AS y, label, truth, ordinal
        FROM painted, range(-4, 5) a(dx), range(-4, 5) b(dy)
        WHERE x + dx >= 0 AND y + dy >= 0 AND x + dx < 40 AND y + dy < 32),
        canvas AS (SELECT DISTINCT image_id, px AS x, py AS y FROM patches, range(40) a(px), range(32) b(py)),
        scored AS (SELECT c.image_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y,
        coalesce(arg_max(label, ordinal), 0) AS label, coalesce(arg_max(truth, ordinal), 0) AS truth
        FROM canvas c LEFT JOIN spots s ON c.image_id = s.image_id AND c.x = s.x AND c.y = s.y GROUP BY 1, 2, 3)""",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause holding the named twins."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def code_table(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Codes of the patches from ten given centres, and the centres: the first vector per label."""
    from topiclens.operators.codebook import assign_clusters

    p = patches(spark, sf_dir)
    centers = p.groupBy("label").agg(F.min_by("desc", "vec_id").alias("center"))
    centers = centers.select((F.col("label") + 1).alias("code"), "center")
    return assign_clusters(p, centers, ["vec_id"]), centers


SQL["centers"] = """centers AS (SELECT label + 1 AS code, arg_min("desc", vec_id) AS center FROM patches GROUP BY label)"""
SQL["assigned"] = """distances AS (SELECT p.image_id, p.x, p.y, p.vec_id, p.label, p."desc", c.code,
        sqrt(list_sum(list_transform(list_zip(p."desc", c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
        FROM patches p, centers c),
        assigned AS (SELECT image_id, x, y, vec_id, label, "desc", code, dist FROM (SELECT *, row_number()
        OVER (PARTITION BY vec_id ORDER BY dist, code) AS rn FROM distances) WHERE rn = 1)"""
