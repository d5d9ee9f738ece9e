"""Text corpus: tokens, statistics, vocabulary, indexed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, scratch, sql_rnd
from topiclens.catalog.standins import bag, line_stats, order_bag, table, with_sql
from topiclens.functions.scalars import tokens
from topiclens.operators import corpus as C
from topiclens.plans.indexing import index_corpus
from topiclens.session import cut_lineage
from topiclens.sources.tables import read_table
from topiclens.sources.text import explode_lines, read_text_lines, read_vectors_text
from topiclens.spread import top_per_group

TOKENS = r"""tokens AS (SELECT doc_id, term FROM (SELECT doc_id,
    unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS term FROM documents) WHERE term <> '')"""
STATS = """stats AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM bag GROUP BY term)"""
VOCAB = """band AS (SELECT * FROM stats WHERE df > 0.002 * (SELECT count(DISTINCT title) FROM bag)
    AND df < 0.5 * (SELECT count(DISTINCT title) FROM bag)),
    vocab AS (SELECT row_number() OVER (ORDER BY df DESC, tf DESC, term) AS term_id, term, df, tf FROM band),
    titles AS (SELECT row_number() OVER (ORDER BY title) AS doc_no, title FROM (SELECT DISTINCT title FROM bag))"""


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM "
       "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def text_lines(spark, d):
    lines = explode_lines(table(spark, d, "documents").select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM "
       "(SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE true")
def text_file_lines(spark, d):
    """Lines of text files written from the conversations."""
    path = scratch(spark, "lines")
    table(spark, d, "conversations").select(F.regexp_replace("text", "\r", " ").alias("t")).write.text(path)
    return read_text_lines(spark, path).agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def table_scan(spark, d):
    """Column pruning and filter push-down of a table scan."""
    return read_table(spark, f"{d}/lineitem.parquet").filter("l_quantity >= 45").select(
        "l_orderkey", "l_partkey", "l_quantity"
    )


@query("SELECT vec_id + 1 AS vec_id, len(embedding) AS dim, "
       + sql_rnd("list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)))") + " AS total FROM embeddings")
def vectors_text(spark, d):
    """Vectors written as text lines and numbered by line."""
    path = scratch(spark, "vectors")
    shown = F.array_join(F.transform("embedding", lambda e: e.cast("double").cast("string")), " ")
    table(spark, d, "embeddings").orderBy("vec_id").select(shown.alias("value")).write.text(path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, e: s + e)
    return read_vectors_text(spark, path).select(
        "vec_id", F.size("vec").cast("long").alias("dim"), rnd(total).alias("total")
    )


@query("WITH " + TOKENS + " SELECT doc_id, count(*) AS n_tokens, CAST(sum(length(term)) AS BIGINT) AS n_chars FROM tokens GROUP BY doc_id")
def tokenize_ws(spark, d):
    words = C.tokenize_ws(table(spark, d, "documents").select("doc_id", "text"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("term")).alias("n_chars"))


@query("WITH " + TOKENS + " SELECT term AS word, count(*) AS n FROM tokens GROUP BY term")
def word_count(spark, d):
    return C.word_count(table(spark, d, "documents"))


@query(with_sql("bag") + "SELECT * FROM bag")
def bag_of_words(spark, d):
    return bag(spark, d)


@query(with_sql("order_bag") + "SELECT * FROM order_bag")
def bag_of_order_parts(spark, d):
    return order_bag(spark, d)


@query(with_sql("bag") + ", " + STATS + " SELECT * FROM stats")
def term_stats(spark, d):
    return C.term_stats(bag(spark, d))


@query(with_sql("bag") + "SELECT count(DISTINCT title) AS n_docs, count(DISTINCT term) AS n_terms, CAST(sum(n) AS BIGINT) AS n_tokens FROM bag")
def corpus_totals(spark, d):
    return C.corpus_totals(bag(spark, d), "title")


@query(with_sql("bag") + ", " + STATS + ", " + VOCAB + " SELECT term, df, tf FROM band")
def document_frequency_band(spark, d):
    words = cut_lineage(bag(spark, d))  # read twice
    n_docs = C.corpus_totals(words, "title").first()["n_docs"]
    return C.filter_document_frequency(C.term_stats(words), n_docs, 0.002, 0.5)


@query(with_sql("bag") + ", " + STATS + ", " + VOCAB + " SELECT * FROM vocab")
def vocabulary(spark, d):
    return index_corpus(bag(spark, d), 0.002, 0.5).terms


@query(with_sql("bag") + ", " + STATS + ", " + VOCAB + " SELECT * FROM titles")
def index_titles(spark, d):
    return C.index_titles(bag(spark, d))


@query(with_sql("bag") + ", " + STATS + " SELECT row_number() OVER (ORDER BY df DESC, tf DESC, term) AS term_id, term, df, tf FROM stats")
def index_terms(spark, d):
    """The whole vocabulary, without a band."""
    return C.index_terms(C.term_stats(bag(spark, d)))


@query(with_sql("bag") + ", " + STATS + ", " + VOCAB
       + " SELECT doc_no, term_id, n FROM bag JOIN vocab USING (term) JOIN titles USING (title)")
def index_documents(spark, d):
    return index_corpus(bag(spark, d), 0.002, 0.5).documents


@query(with_sql("bag") + ", " + STATS + ", " + VOCAB + """ SELECT count(*) AS n_docs, CAST(sum(kept) AS BIGINT) AS n_kept,
    CAST(sum(1 - kept) AS BIGINT) AS n_collapsed FROM (SELECT title, max(CASE WHEN vocab.term IS NULL THEN 0 ELSE 1 END) AS kept
    FROM bag LEFT JOIN vocab USING (term) GROUP BY title)""")
def collapsed_documents(spark, d):
    index = index_corpus(bag(spark, d), 0.002, 0.5)
    return C.drop_collapsed(index.bag, index.terms, "title", n_terms=index.n_terms)


SEEDS = r"""seeds AS (SELECT DISTINCT item_id + 1 AS topic, term FROM (SELECT item_id,
    unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS term FROM benchmark) WHERE term <> '')"""


def seeds(spark, d):
    """Topic k = benchmark item k."""
    words = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("topic"), F.explode(tokens("text")).alias("term"))
    return words.distinct()


ALL_TERMS = "vocab AS (SELECT row_number() OVER (ORDER BY df DESC, tf DESC, term) AS term_id, term FROM stats)"


@query(with_sql("bag") + ", " + STATS + ", " + ALL_TERMS + ", " + SEEDS
       + " SELECT topic, CAST(term_id AS BIGINT) AS term_id FROM seeds JOIN vocab USING (term)")
def seed_words(spark, d):
    terms = index_corpus(bag(spark, d), 0.0, None).terms
    return C.seed_words_to_ids(seeds(spark, d), terms).select("topic", "term_id")


@query(with_sql("bag") + ", " + STATS + ", " + ALL_TERMS + ", " + SEEDS + " SELECT topic, term FROM seeds ANTI JOIN vocab USING (term)")
def unknown_seed_words(spark, d):
    return C.unknown_seed_words(seeds(spark, d), index_corpus(bag(spark, d), 0.0, None).terms)


@query(with_sql("bag") + ", " + STATS + " SELECT term, df, tf, row_number() OVER (ORDER BY df DESC, tf DESC, term) AS place FROM stats")
def sort_by_frequency(spark, d):
    """Global sort by document and total frequency, with each row's place."""
    from topiclens.spread import number_rows

    ranked = number_rows(C.term_stats(bag(spark, d)), [F.desc("df"), F.desc("tf"), F.asc("term")], "place")
    return ranked.select("term", "df", "tf", "place")


@query(with_sql("line_stats") + "SELECT topic, term_id, " + sql_rnd("log_stat") + """ AS log_stat, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY topic ORDER BY log_stat DESC, term_id) AS rank FROM line_stats) WHERE rank <= 25""")
def top_k_per_group(spark, d):
    best = top_per_group(line_stats(spark, d), ["topic"], [F.desc("log_stat"), F.asc("term_id")], 25)
    return best.select("topic", "term_id", rnd("log_stat").alias("log_stat"), F.col("rank").cast("long").alias("rank"))
