"""Files, images and image features."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, scratch, sql_rnd
from topiclens.catalog.standins import (
    bag, code_table, large_mosaics, mosaic_sizes, mosaics, order_bag, rgb_pixels, table, with_sql,
)
from topiclens.operators import images as I
from topiclens.operators import labels as L
from topiclens.session import cut_lineage
from topiclens.sinks import writers as W
from topiclens.sinks.images import encode_bitmaps, write_files
from topiclens.sources import files as R
from topiclens.sources.tables import read_table


def mosaic_rgb(spark, d):
    """Packed-colour pixels of the 40 x 32 mosaics: tile positions over 8 x 8 pixels."""
    p = rgb_pixels(spark, d)
    k = F.expr("cast(pmod(image_id, 20) as int)")
    return p.select(
        F.expr("cast(image_id div 20 as int)").alias("image_id"), ((k % 5) * 8 + F.col("x")).alias("x"),
        (F.expr("cast(cast(pmod(image_id, 20) as int) div 5 as int)") * 8 + F.col("y")).alias("y"), "rgb",
    )


def mosaic_rgb_images(spark, d):
    return I.assemble_images(mosaic_rgb(spark, d), mosaic_sizes(spark, d), "rgb", 0)


MOSAIC = """mosaic AS (SELECT CAST(image_id // 20 AS INTEGER) AS image_id, CAST((image_id % 20) % 5 * 8 + x AS INTEGER) AS x,
    CAST((image_id % 20) // 5 * 8 + y AS INTEGER) AS y, rgb FROM rgb)"""
WHOLE = """whole AS (SELECT i.image_id, CAST(px AS INTEGER) AS x, CAST(py AS INTEGER) AS y, coalesce(m.rgb, 0) AS rgb FROM
    (SELECT DISTINCT image_id FROM mosaic) i CROSS JOIN range(40) a(px) CROSS JOIN range(32) b(py) LEFT JOIN mosaic m ON m.image_id = i.image_id AND m.x = px AND m.y = py)"""
ALL = with_sql("pixels", "rgb") + ", " + MOSAIC + ", " + WHOLE


def image_folder(spark, d) -> str:
    """Bitmap files of the mosaics, written by the tasks; folders are named by image."""
    path = scratch(spark, "bitmaps")
    write_files(encode_bitmaps(mosaic_rgb_images(spark, d)), path)
    return path


def folder_manifest(spark, path):
    """``(image_id, path)`` of the written bitmaps from their folder names."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return listed.select(folder(F.col("path")).cast("int").alias("image_id"), "path")


def folder(path):
    """The image number in a path: the name manifest and files share."""
    return F.regexp_extract(path, "image_id=(\\d+)", 1)


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def whole_files(spark, d):
    """Files written from the documents, each read whole."""
    path = scratch(spark, "files")
    write_files(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), path, "doc_id")
    read = R.read_whole_files(spark, path, "part-*")
    number = F.regexp_extract("path", "doc_id=(\\d+)", 1).cast("long")
    return read.select(number.alias("doc_id"), F.md5("content").alias("md5"), F.length("content").cast("long").alias("n_bytes"))


@query("SELECT CAST(doc_id AS INTEGER) AS image_id, source || '/' || doc_id AS path FROM documents")
def manifest_text(spark, d):
    path = scratch(spark, "manifest")
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    docs.write.csv(path, sep="\t")
    return R.read_manifest(spark, path)


@query(ALL + """SELECT CAST(row_number() OVER (ORDER BY image_id || '/') AS INTEGER) AS image_id, image_id AS folder
    FROM (SELECT DISTINCT image_id FROM mosaic)""")
def build_manifest(spark, d):
    """Files numbered from 1 in path order."""
    found = R.build_manifest(spark, image_folder(spark, d), "part-*")
    return found.select("image_id", F.regexp_extract("path", "image_id=(\\d+)", 1).cast("int").alias("folder"))


@query(ALL + "SELECT image_id, count(*) AS n_pixels, CAST(sum((rgb >> 16) & 255) AS BIGINT) AS r, CAST(sum((rgb >> 8) & 255) AS BIGINT) AS g, "
       "CAST(sum(rgb & 255) AS BIGINT) AS b FROM whole GROUP BY image_id")
def decode_images(spark, d):
    """Bitmaps decoded by the image source: channel sums."""
    path = image_folder(spark, d)
    rgb = I.decoded_rgb(R.decode_images(spark, path), folder_manifest(spark, path), folder)
    px = I.image_pixels(rgb, "rgb")
    part = lambda bits: F.sum(F.shiftright("rgb", bits).bitwiseAND(255)).cast("long")
    return px.groupBy("image_id").agg(F.count("*").alias("n_pixels"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


@query(ALL + "SELECT DISTINCT image_id, CAST(40 AS INTEGER) AS width, CAST(32 AS INTEGER) AS height FROM mosaic")
def image_sizes(spark, d):
    path = image_folder(spark, d)
    return R.image_sizes(folder_manifest(spark, path), R.decode_images(spark, path), folder).select("image_id", "width", "height")


def mixed_folder(spark, d) -> str:
    """Bitmaps and web pages in one folder tree."""
    path = scratch(spark, "mixed")
    write_files(encode_bitmaps(mosaic_rgb_images(spark, d)).select(F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("name"), "content"), path, "name")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    write_files(pages, path, "name")
    return path


GREY = "0.3 * ((rgb >> 16) & 255) + 0.6 * ((rgb >> 8) & 255) + 0.1 * (rgb & 255)"


@query(ALL + f""", ends AS (SELECT image_id, max({GREY}) FILTER (x = 0 AND y = 0) AS a, max({GREY}) FILTER (x = 39 AND y = 31) AS b FROM whole GROUP BY 1)
    SELECT 'image-' || image_id AS name, CASE WHEN a < b THEN 'ValueError: brighter at its end' END AS reason FROM ends
    UNION ALL SELECT 'page-' || page_id, 'not an image' FROM pages""")
def account_files(spark, d):
    """Every file of a mixed folder: an image that a kernel takes, or why it is left out."""

    def kernel(image):
        if image[0, 0] < image[-1, -1]:
            raise ValueError("brighter at its end")
        yield ()

    files = R.decode_images(spark, mixed_folder(spark, d), drop_invalid=False, glob="part-*")
    found = I.account_files(files, kernel)
    return found.select(F.regexp_extract("path", "name=(.*)$", 1).alias("name"), "reason")


@query("SELECT 'page-' || page_id AS name FROM pages")
def skip_bad_images(spark, d):
    """Bitmaps and web pages in one folder tree: the pages are listed as unreadable."""
    path = mixed_folder(spark, d)
    return R.bad_images(spark, path, "part-*").select(F.regexp_extract("path", "name=(.*)$", 1).alias("name"))


@query(ALL + ", firsts AS (SELECT rgb, min((image_id, x, y)) AS seen FROM whole GROUP BY rgb), colors AS (SELECT rgb, "
       "CAST(row_number() OVER (ORDER BY seen, rgb) - 1 AS INTEGER) AS label FROM firsts) SELECT image_id, x, y, label FROM whole JOIN colors USING (rgb)")
def images_to_pixels(spark, d):
    """Decoded bitmaps to labelled pixels."""
    path = image_folder(spark, d)
    rgb = cut_lineage(I.decoded_rgb(R.decode_images(spark, path), folder_manifest(spark, path), folder))
    colors = L.build_color_map(I.image_pixels(rgb, "rgb"))
    return I.images_to_pixels(rgb, colors, grouped=True)


@query(ALL + "SELECT image_id, x, y, rgb FROM whole")
def pixels_to_images(spark, d):
    """Labelled pixels to images and back to pixels."""
    p = mosaic_rgb(spark, d)
    colors = cut_lineage(L.build_color_map(p))
    named = L.map_colors(p, colors).select("image_id", "x", "y", "label")
    return I.image_pixels(I.pixels_to_images(named, colors, mosaic_sizes(spark, d)), "rgb")


@query(ALL + "SELECT image_id, " + sql_rnd("sum(0.3 * ((rgb >> 16) & 255) + 0.6 * ((rgb >> 8) & 255) + 0.1 * (rgb & 255))", 4) + " AS grey FROM whole GROUP BY image_id")
def grey_images(spark, d):
    grey = I.grey_images(mosaic_rgb_images(spark, d))
    return grey.select("image_id", rnd(F.aggregate("data", F.lit(0.0), lambda s, v: s + v), 4).alias("grey"))


@query()
def prepare_images(spark, d):
    """Normalised and pre-blurred images: their sums."""
    out = I.prepare_images(mosaics(spark, d))
    return out.select("image_id", "width", "height", "scale", rnd(F.aggregate("data", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query()
def resize_nearest(spark, d):
    """Images shrunk to 60 percent, as pixels."""
    small = I.resize_images(mosaics(spark, d), 0.6)
    return I.image_pixels(small).select("image_id", "x", "y", rnd("v").alias("v"))


@query()
def resize_enlarge(spark, d):
    """Images enlarged to 150 percent, as pixels."""
    return I.image_pixels(I.resize_images(mosaics(spark, d), 1.5)).select("image_id", "x", "y", rnd("v").alias("v"))


@query()
def scale_space(spark, d):
    """Levels and differences of every octave: size and mean."""
    levels = I.scale_space(large_mosaics(spark, d), min_side=32)
    mean = F.aggregate("data", F.lit(0.0), lambda s, v: s + v) / F.size("data")
    return levels.select("image_id", "octave", "kind", "level", "width", "height", rnd(mean).alias("mean"))


@query()
def dense_features(spark, d):
    """Grid descriptors of the mosaics: one row per descriptor entry."""
    found = I.dense_features(mosaics(spark, d))
    return found.select("image_id", "x", "y", F.posexplode("desc").alias("i", "v")).select("image_id", "x", "y", "i", rnd("v").alias("v"))


@query()
def dense_features_inside(spark, d):
    """Grid descriptors kept inside the image, normalised by their maximum."""
    found = I.dense_features(mosaics(spark, d), policy="inside", norm="max")
    return found.select("image_id", "x", "y", rnd(F.aggregate("desc", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query()
def keypoints(spark, d):
    found = I.keypoints(large_mosaics(spark, d), min_side=32)
    return found.select("image_id", "octave", *(rnd(c).alias(c) for c in ("x", "y", "level")))


@query()
def keypoint_features(spark, d):
    """Descriptors at key points, with scale and orientation."""
    found = I.keypoint_features(large_mosaics(spark, d), min_side=32)
    norm = F.sqrt(F.aggregate("desc", F.lit(0.0), lambda s, v: s + v * v))
    return found.select("image_id", *(rnd(c).alias(c) for c in ("scale", "orientation", "x", "y")), rnd(norm).alias("norm"))


@query("SELECT CAST(sum(strlen(html)) AS BIGINT) AS n_bytes, count(*) AS n_files FROM pages")
def pack_files(spark, d):
    """One file per page packed into two compressed files."""
    src, dst = scratch(spark, "pages"), scratch(spark, "packed")
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), F.encode("html", "UTF-8").alias("content"))
    write_files(pages, src, "name")
    W.pack_files(spark, src, dst, parts=2, glob="part-*")
    return read_table(spark, dst).agg(F.sum(F.length("content")).cast("long").alias("n_bytes"), F.count("*").alias("n_files"))


@query(with_sql("order_bag") + "SELECT * FROM order_bag")
def write_table(spark, d):
    path = scratch(spark, "table")
    W.write_table(order_bag(spark, d), path)
    return read_table(spark, path)


@query(with_sql("bag") + "SELECT 'titles' AS kind, count(DISTINCT title) AS n FROM bag UNION ALL SELECT 'words', count(*) FROM bag "
       "UNION ALL SELECT 'terms', count(DISTINCT term) FROM bag")
def write_many(spark, d):
    """Three tables from one pass over the documents."""
    root = scratch(spark, "many")
    W.write_many(
        bag(spark, d),
        {"titles": lambda b: b.select("title").distinct(), "words": ["title", "term", "n"], "terms": lambda b: b.groupBy("term").agg(F.sum("n").alias("tf"))},
        root,
    )
    count = lambda kind: read_table(spark, f"{root}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("titles").unionByName(count("words")).unionByName(count("terms"))


@query(with_sql("order_bag") + "SELECT * FROM order_bag")
def merge_parts(spark, d):
    """Two part tables, split by size of the count, merged into one."""
    root, merged = scratch(spark, "parts"), scratch(spark, "merged")
    rows = order_bag(spark, d)
    W.write_table(rows.filter("n < 25"), f"{root}/part-low")
    W.write_table(rows.filter("n >= 25"), f"{root}/part-high")
    W.merge_parts(spark, [f"{root}/part-*"], merged, 2)
    return read_table(spark, merged)


@query(with_sql("bag") + r"SELECT term || chr(9) || CAST(sum(n) AS BIGINT) AS value FROM bag GROUP BY term "
       "UNION ALL SELECT 'Total number of Entries: ' || count(DISTINCT term) FROM bag")
def dump_text(spark, d):
    """Any table as key-value lines with a closing count."""
    words = bag(spark, d).groupBy("term").agg(F.sum("n").alias("tf"))
    return W.dump_lines(words, "term", "tf")


@query(with_sql("patches", "centers", "assigned") + "SELECT image_id, x, y, code FROM assigned")
def split_by_image(spark, d):
    """One folder of rows per image, read back."""
    path = scratch(spark, "split")
    W.split_by_image(code_table(spark, d)[0], path)
    back = spark.read.schema("x INT, y INT, code INT, image_id INT").csv(path, sep="\t")
    return back.select("image_id", "x", "y", "code")
