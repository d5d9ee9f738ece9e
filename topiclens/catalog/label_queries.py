"""Labels on patches and pixels, colours, painting and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, scratch, sql_rnd
from topiclens.catalog.standins import (
    PALETTE, code_table, mosaic_sizes, painted, phi, pixels, rgb_pixels, table, with_sql,
)
from topiclens.functions import scalars as S
from topiclens.operators import corpus as C
from topiclens.operators import labels as L
from topiclens.sinks.writers import color_map_lines, write_color_map
from topiclens.sources.text import read_color_map

CUTOFF = 0.05
LABELS = f"""labels0 AS (SELECT doc_no, term_id, n, CAST(coalesce(list_position(list_transform(log_phi,
    lambda p: p >= ln({CUTOFF})), true), 0) AS INTEGER) AS label FROM phi)"""


@query(with_sql("phi") + ", " + LABELS + " SELECT doc_no, term_id, label FROM labels0")
def label_from_probability(spark, d):
    return L.label_terms(phi(spark, d), CUTOFF)


NAMES = """words AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS term_id, p_name || '#' || p_partkey AS term FROM part),
    names AS (SELECT DISTINCT doc_no, 'image-' || doc_no AS title FROM phi)"""


def _names(spark, d):
    words = table(spark, d, "part").select(
        (F.col("p_partkey") + 1).cast("int").alias("term_id"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("term")
    )
    docs = phi(spark, d).select("doc_no").distinct()
    return words, docs.select("doc_no", F.concat(F.lit("image-"), F.col("doc_no").cast("string")).alias("title"))


@query(with_sql("phi") + ", " + LABELS + ", " + NAMES + " SELECT title, term, label FROM labels0 JOIN words USING (term_id) JOIN names USING (doc_no)")
def decode_labels(spark, d):
    words, names = _names(spark, d)
    return C.decode_labels(L.label_terms(phi(spark, d), CUTOFF), words, names)


@query(with_sql("phi") + ", " + LABELS + ", " + NAMES + """ SELECT title, count(*) AS n_terms, CAST(sum(label) AS BIGINT) AS total,
    CAST(count(DISTINCT label) AS BIGINT) AS n_labels FROM labels0 JOIN words USING (term_id) JOIN names USING (doc_no) GROUP BY title""")
def annotate(spark, d):
    """Probabilities to labelled documents, one map per document."""
    from topiclens.plans.labelling import annotate as run

    words, names = _names(spark, d)
    maps = run(phi(spark, d), words, names, CUTOFF)
    values = F.map_values("labels")
    return maps.select(
        "title", F.size("labels").cast("long").alias("n_terms"),
        F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"),
        F.size(F.array_distinct(values)).cast("long").alias("n_labels"),
    )


TEXT_LABELS = """text_labels AS (SELECT CAST(doc_no AS VARCHAR) AS title, CAST(term_id AS VARCHAR) AS term, label FROM labels0)"""


def _text_labels(spark, d):
    named = L.label_terms(phi(spark, d), CUTOFF)
    return named.select(F.col("doc_no").cast("string").alias("title"), F.col("term_id").cast("string").alias("term"), "label")


@query(with_sql("phi") + ", " + LABELS + " SELECT CAST(doc_no AS INTEGER) AS image_id, term_id AS code, label FROM labels0")
def cast_labels(spark, d):
    return L.cast_labels(_text_labels(spark, d))


@query(with_sql("phi") + ", " + LABELS + " SELECT CAST(doc_no AS INTEGER) AS image_id, term_id AS code, label FROM labels0")
def cast_label_maps(spark, d):
    """The map form, exploded for comparison."""
    maps = _text_labels(spark, d).groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("term", "label"))).alias("labels"))
    return L.cast_label_maps(maps).select("image_id", F.explode("labels").alias("code", "label"))


TOPICS = """topics AS (SELECT CAST(doc_no AS INTEGER) AS image_id, term_id AS code, label AS topic FROM labels0 WHERE label > 0)"""


@query(with_sql("patches", "centers", "assigned", "phi") + ", " + LABELS + ", " + TOPICS
       + " SELECT image_id, x, y, topic FROM assigned LEFT JOIN topics USING (image_id, code)")
def join_code_topic(spark, d):
    codes, _ = code_table(spark, d)
    named = L.cast_labels(_text_labels(spark, d)).filter("label > 0")
    return L.join_code_topic(codes.select("image_id", "x", "y", "code"), named)


@query(with_sql("patches", "centers", "assigned", "phi") + ", " + LABELS + ", " + TOPICS + """,
    shown AS (SELECT image_id, x, y, coalesce(topic, 0) AS topic, vec_id FROM assigned LEFT JOIN topics USING (image_id, code)),
    spots AS (SELECT image_id, x + dx AS x, y + dy AS y, topic, vec_id FROM shown, range(-4, 5) a(dx), range(-4, 5) b(dy)),
    canvas AS (SELECT DISTINCT image_id, px AS x, py AS y FROM patches, range(40) a(px), range(32) b(py))
    SELECT c.image_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, coalesce(arg_max(topic, vec_id), 0) AS label
    FROM canvas c LEFT JOIN spots s ON c.image_id = s.image_id AND c.x = s.x AND c.y = s.y GROUP BY 1, 2, 3""")
def label_pixels(spark, d):
    """Topic probabilities and code positions to labelled pixels."""
    from topiclens.plans.labelling import label_pixels as run

    codes, _ = code_table(spark, d)
    words = phi(spark, d).select("term_id").distinct().select("term_id", F.col("term_id").cast("string").alias("term"))
    names = phi(spark, d).select("doc_no").distinct().select("doc_no", F.col("doc_no").cast("string").alias("title"))
    marked = codes.select("image_id", "x", "y", "code", F.col("vec_id").alias("ordinal"))
    return run(phi(spark, d), words, names, marked, mosaic_sizes(spark, d), CUTOFF)


@query(with_sql("pixels", "rgb") + "SELECT image_id, x, y, rgb, (rgb >> 16) & 255 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b, "
       + sql_rnd("0.3 * ((rgb >> 16) & 255) + 0.6 * ((rgb >> 8) & 255) + 0.1 * (rgb & 255)") + " AS grey FROM rgb")
def rgb_channels(spark, d):
    p = rgb_pixels(spark, d)
    return p.select("image_id", "x", "y", "rgb", S.rgb_channels("rgb").alias("c"), rnd(S.luma("rgb")).alias("grey")).select(
        "image_id", "x", "y", "rgb", "c.*", "grey"
    )


@query(with_sql("pixels", "rgb") + "SELECT image_id, x, y, 16641 * ((rgb >> 16) & 255) + 129 * ((rgb >> 8) & 255) + (rgb & 255) AS code FROM rgb")
def color_code(spark, d):
    ch = S.rgb_channels("rgb")
    return rgb_pixels(spark, d).select("image_id", "x", "y", S.color_code(ch["r"], ch["g"], ch["b"]).alias("code"))


COLORS = """firsts AS (SELECT rgb, min((image_id, x, y)) AS seen FROM rgb GROUP BY rgb),
    colors AS (SELECT rgb, CAST(row_number() OVER (ORDER BY seen, rgb) - 1 AS INTEGER) AS label FROM firsts)"""


@query(with_sql("pixels", "rgb") + ", " + COLORS + " SELECT * FROM colors")
def build_color_map(spark, d):
    return L.build_color_map(rgb_pixels(spark, d))


@query(with_sql("pixels", "rgb") + ", " + COLORS + " SELECT * FROM colors")
def color_map_text(spark, d):
    """Colour map written as text and parsed back."""
    path = scratch(spark, "colors")
    write_color_map(L.build_color_map(rgb_pixels(spark, d)), path)
    return read_color_map(spark, path)


@query(with_sql("pixels", "rgb") + ", " + COLORS + " SELECT '(' || rgb || ',' || label || ')' AS value FROM colors")
def color_map_lines_dump(spark, d):
    return color_map_lines(L.build_color_map(rgb_pixels(spark, d)))


@query(with_sql("pixels", "rgb") + ", " + COLORS + " SELECT image_id, x, y, rgb, label FROM rgb LEFT JOIN colors USING (rgb)")
def map_colors(spark, d):
    p = rgb_pixels(spark, d)
    return L.map_colors(p, L.build_color_map(p)).select("image_id", "x", "y", "rgb", "label")


@query(with_sql("pixels", "rgb") + ", " + COLORS + """, part_colors AS (SELECT rgb, label * 2 AS label FROM colors)
    SELECT image_id, x, y, label, coalesce(part_colors.rgb, 0) AS rgb FROM (SELECT image_id, x, y, label FROM rgb JOIN colors USING (rgb)) p
    LEFT JOIN part_colors USING (label)""")
def colorize(spark, d):
    """Labels back to colours; labels without one give 0."""
    p = rgb_pixels(spark, d)
    colors = L.build_color_map(p)
    named = L.map_colors(p, colors).select("image_id", "x", "y", "label")
    return L.colorize(named, colors.withColumn("label", F.col("label") * 2)).select("image_id", "x", "y", "label", "rgb")


@query(with_sql("pixels", "rgb") + "SELECT image_id, x, y, rgb AS value FROM rgb")
def rekey_pixels(spark, d):
    """Position keys to image keys and back."""
    p = rgb_pixels(spark, d).withColumnRenamed("rgb", "value")
    back = L.rekey_by_position(L.rekey_by_image(p))
    return back.select("position.*", "value")


@query(with_sql("pixels", "rgb") + "SELECT rgb AS value, image_id, x, y FROM rgb")
def rekey_by_value(spark, d):
    return L.rekey_by_value(rgb_pixels(spark, d).withColumnRenamed("rgb", "value")).select("value", "position.*")


@query(with_sql("pixels", "rgb") + ", " + COLORS + """ SELECT label, image_id, x, y,
    row_number() OVER (ORDER BY label, image_id, y, x) AS place FROM rgb JOIN colors USING (rgb)""")
def group_pixels_by_label(spark, d):
    """Pixels in label order, with each one's place."""
    from topiclens.spread import number_rows

    p = rgb_pixels(spark, d)
    named = L.map_colors(p, L.build_color_map(p)).select("label", "image_id", "x", "y")
    return number_rows(L.group_pixels_by_label(named), [F.col(c) for c in ("label", "image_id", "y", "x")], "place")


ENTRIES = "(VALUES " + ", ".join(f"({i + 1}, {129 * 129 * r + 129 * g + b})" for i, (r, g, b) in enumerate(PALETTE)) + ") t(entry, code)"


@query(with_sql("pixels", "rgb") + f"""SELECT image_id, x, y, rgb, CAST(arg_min(entry, (abs(16641 * ((rgb >> 16) & 255) + 129 * ((rgb >> 8) & 255)
    + (rgb & 255) - code), entry)) AS INTEGER) AS truth FROM rgb, {ENTRIES} GROUP BY image_id, x, y, rgb""")
def truth_labels(spark, d):
    """Nearest palette entry of every pixel."""
    return L.nearest_palette(rgb_pixels(spark, d), PALETTE)


def _scored(spark, d):
    predicted, truth = painted(spark, d)
    sizes = mosaic_sizes(spark, d)
    right = L.paint_patches(truth, sizes).withColumnRenamed("label", "truth")
    return L.join_truth(L.paint_patches(predicted, sizes), right)


@query(with_sql("patches", "painted", "canvas") + "SELECT image_id, x, y, label FROM scored")
def paint_patches(spark, d):
    return L.paint_patches(painted(spark, d)[0], mosaic_sizes(spark, d))


@query(with_sql("patches", "painted", "canvas") + "SELECT image_id, x, y, label, truth FROM scored")
def join_truth(spark, d):
    return _scored(spark, d)


@query(with_sql("patches", "painted", "canvas") + """SELECT truth, label, n FROM (SELECT *, row_number() OVER (PARTITION BY truth
    ORDER BY n DESC, label) AS rn FROM (SELECT truth, label, count(*) AS n FROM scored GROUP BY 1, 2)) WHERE rn = 1""")
def class_to_topic(spark, d):
    return L.class_to_topic(_scored(spark, d))


@query(with_sql("patches", "painted", "canvas") + """, chosen AS (SELECT truth, label FROM (SELECT *, row_number() OVER (PARTITION BY truth
    ORDER BY n DESC, label) AS rn FROM (SELECT truth, label, count(*) AS n FROM scored GROUP BY 1, 2)) WHERE rn = 1)
    SELECT c.truth, c.label, """ + sql_rnd("sum((s.truth = c.truth AND s.label = c.label)::INT) / sum((s.truth = c.truth)::INT)")
       + " AS detection, " + sql_rnd("sum((s.truth <> c.truth AND s.truth <> 1 AND s.label = c.label)::INT) / nullif(sum((s.truth <> 1 AND s.label = c.label)::INT), 0)")
       + " AS false_alarm FROM chosen c, scored s WHERE c.truth <> 1 GROUP BY 1, 2")
def detection_false_alarm(spark, d):
    scores = L.detection_false_alarm(_scored(spark, d))
    return scores.select("truth", "label", rnd("detection").alias("detection"), rnd("false_alarm").alias("false_alarm"))


@query("""WITH joined AS (SELECT d.lang AS label0, l.quality + 1 AS truth, CAST(length(d.lang) + ascii(d.lang) % 5 AS INTEGER) AS label
    FROM documents d JOIN labels l USING (doc_id)), counts AS (SELECT truth, label, count(*) AS n FROM joined GROUP BY 1, 2)
    SELECT truth, label, n FROM counts""")
def truth_counts(spark, d):
    """Class by predicted label on the labelled documents: the table both scores are read from."""
    docs = table(spark, d, "documents").select("doc_id", (F.length("lang") + F.ascii("lang") % 5).alias("label"))
    truth = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("truth"))
    return docs.join(truth, "doc_id").groupBy("truth", "label").agg(F.count("*").alias("n"))


@query(with_sql("patches", "pixels") + """SELECT image_id, x, y, CAST(CASE WHEN ((x * 5 - 9) % 16 + 16) % 16 < 8 THEN ((x * 5 - 9) % 16 + 16) % 16
    ELSE 15 - ((x * 5 - 9) % 16 + 16) % 16 END AS INTEGER) AS mirrored FROM pixels""")
def mirror_index(spark, d):
    """Reflected positions of indices far outside the line."""
    p = pixels(spark, d)
    return p.select("image_id", "x", "y", S.mirror_index(F.col("x") * 5 - 9, F.lit(8)).alias("mirrored"))


