"""Topic model: special functions, statistics, training and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from topiclens.catalog.registry import query, rnd, scratch, sql_rnd
from topiclens.catalog.standins import bag, code_table, line_stats, mosaic_sizes, order_bag, part_terms, phi, table, with_sql
from topiclens.functions import scalars as S
from topiclens.functions.draws import mix
from topiclens.functions.special import digamma_col, lgamma_col, trigamma_col
from topiclens.operators import spatial as P
from topiclens.operators import topics as T
from topiclens.plans import training as M
from topiclens.plans.indexing import index_corpus
from topiclens.session import cut_lineage

ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query(f"""SELECT {ITEM}, {sql_rnd('greatest(a, b) + ln(1 + exp(-abs(a - b)))')} AS total FROM
    (SELECT *, ln(l_quantity) AS a, ln(l_extendedprice) AS b FROM lineitem)""")
def log_add(spark, d):
    both = S.log_add(F.log("l_quantity"), F.log("l_extendedprice"))
    return table(spark, d, "lineitem").select(*ITEM.split(", "), rnd(both).alias("total"))


PSI = """ln(q + 20) - 1 / (2 * (q + 20)) - 1 / (12 * pow(q + 20, 2)) + 1 / (120 * pow(q + 20, 4)) - 1 / (252 * pow(q + 20, 6))
    - list_sum(list_transform(range(20), lambda i: 1 / (q + i)))"""
PSI1 = """1 / (q + 20) + 1 / (2 * pow(q + 20, 2)) + 1 / (6 * pow(q + 20, 3)) - 1 / (30 * pow(q + 20, 5)) + 1 / (42 * pow(q + 20, 7))
    + list_sum(list_transform(range(20), lambda i: 1 / pow(q + i, 2)))"""


@query(f"""SELECT {ITEM}, {sql_rnd(PSI)} AS psi, {sql_rnd(PSI1)} AS psi1, {sql_rnd('lgamma(q)')} AS lg
    FROM (SELECT *, l_quantity / 10 AS q FROM lineitem)""")
def special_functions(spark, d):
    q = F.col("l_quantity") / 10
    return table(spark, d, "lineitem").select(
        *ITEM.split(", "), rnd(digamma_col(q)).alias("psi"), rnd(trigamma_col(q)).alias("psi1"), rnd(lgamma_col(q)).alias("lg")
    )


@query("SELECT l_linenumber AS topic, l_partkey AS term_id, " + sql_rnd("ln(sum(exp(ln(l_quantity))))") + " AS total FROM lineitem GROUP BY 1, 2")
def log_sum_exp(spark, d):
    items = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("topic"), F.col("l_partkey").alias("term_id"), F.log("l_quantity").alias("v")
    )
    sums = T.log_sum_exp(items, ["topic", "term_id"], "v", "total")
    return sums.select("topic", "term_id", rnd("total").alias("total"))


STATS = """stats AS (SELECT CAST(k + 1 AS INTEGER) AS topic, term_id, ln(sum(exp(log_phi[k + 1]) * n)) AS log_stat
    FROM phi, range(64) t(k) GROUP BY 1, 2)"""


@query(with_sql("phi") + ", " + STATS + " SELECT topic, term_id, " + sql_rnd("log_stat") + " AS log_stat, "
       + sql_rnd("ln(sum(exp(log_stat)) OVER (PARTITION BY topic))") + " AS log_norm FROM stats")
def beta_statistics(spark, d):
    """Topic-term statistics with the normaliser of each topic."""
    found = T.with_norms(T.beta_statistics(phi(spark, d)))
    return found.select("topic", "term_id", rnd("log_stat").alias("log_stat"), rnd("log_norm").alias("log_norm"))


@query(with_sql("line_stats") + "SELECT topic, term_id, " + sql_rnd(
    "ln(exp(log_stat) / (sum(exp(log_stat)) OVER (PARTITION BY topic) + 1e-8 * (SELECT count(DISTINCT term_id) FROM line_stats)) + 1e-8)")
    + " AS log_beta FROM line_stats")
def normalize_beta(spark, d):
    stats = line_stats(spark, d)
    n_terms = stats.select("term_id").distinct().count()
    return T.normalize_beta(stats, n_terms).select("topic", "term_id", rnd("log_beta").alias("log_beta"))


@query(with_sql("line_stats") + """, full_stats AS (SELECT topic, term_id FROM (SELECT DISTINCT topic FROM line_stats), (SELECT DISTINCT term_id FROM line_stats))
    SELECT f.topic, f.term_id, """ + sql_rnd("coalesce(log_stat, ln(1e-8))") + """ AS log_beta FROM full_stats f
    LEFT JOIN line_stats s ON f.topic = s.topic AND f.term_id = s.term_id""")
def fill_absent_beta(spark, d):
    """Terms missing from a topic get the floor weight."""
    rows = T.fill_absent(line_stats(spark, d).withColumnRenamed("log_stat", "log_beta"), 7)
    return M.beta_long(rows).select("topic", "term_id", rnd("log_beta").alias("log_beta"))


@query(with_sql("line_stats") + """, cut AS (SELECT topic, term_id, log_stat FROM (SELECT *, row_number() OVER (PARTITION BY topic
    ORDER BY log_stat DESC, term_id) AS rn FROM line_stats) WHERE rn <= 500)
    SELECT topic, term_id, """ + sql_rnd("log_stat") + " AS log_stat, " + sql_rnd("ln(sum(exp(log_stat)) OVER (PARTITION BY topic))")
       + " AS log_norm FROM cut")
def truncate_beta(spark, d):
    cut = T.truncate_beta(line_stats(spark, d), 500)
    return cut.select("topic", "term_id", rnd("log_stat").alias("log_stat"), rnd("log_norm").alias("log_norm"))


@query(with_sql("line_stats") + "SELECT topic, rank, term_id, p_name AS term, " + sql_rnd("log_stat") + """ AS log_stat FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY topic ORDER BY log_stat DESC, term_id) AS INTEGER) AS rank FROM line_stats)
    JOIN part ON p_partkey = term_id WHERE rank <= 10""")
def top_terms(spark, d):
    best = T.top_terms(line_stats(spark, d), part_terms(spark, d), 10, "log_stat")
    return best.select("topic", "rank", "term_id", "term", rnd("log_stat").alias("log_stat"))


@query(with_sql("line_stats") + """, seeded AS (SELECT DISTINCT p_size % 7 + 1 AS topic, p_partkey AS term_id FROM part)
    SELECT s.topic, s.term_id, """ + sql_rnd("ln(exp(log_stat) + CASE WHEN k.term_id IS NULL THEN 0.01 ELSE 10 END)")
       + " AS log_stat FROM line_stats s LEFT JOIN seeded k ON s.topic = k.topic AND s.term_id = k.term_id")
def informed_prior(spark, d):
    """Parts seed the topic given by their size."""
    seeds = table(spark, d, "part").select((F.col("p_size") % 7 + 1).alias("topic"), F.col("p_partkey").alias("term_id"))
    return T.informed_prior(line_stats(spark, d), seeds).select("topic", "term_id", rnd("log_stat").alias("log_stat"))


@query(with_sql("line_stats") + "SELECT topic, term_id, row_number() OVER (ORDER BY topic, term_id) AS place FROM line_stats")
def sort_by_topic(spark, d):
    from topiclens.spread import number_rows

    return number_rows(T.sort_by_topic(line_stats(spark, d)), [F.col("topic"), F.col("term_id")], "place").select("topic", "term_id", "place")


GAMMA = "list_transform(embedding, lambda e: CAST(e AS DOUBLE) + 1)"


@query(f"""WITH g AS (SELECT {GAMMA} AS gamma, list_sum({GAMMA}) AS total FROM embeddings), q1 AS (SELECT CAST(k + 1 AS INTEGER) AS topic,
    gamma[k + 1] AS a, total AS b FROM g, range(64) t(k)), p AS (SELECT topic, {PSI.replace('q', 'a')} AS pa, {PSI.replace('q', 'b')} AS pb FROM q1)
    SELECT topic, {sql_rnd('sum(pa - pb)')} AS stat FROM p GROUP BY topic""")
def alpha_statistics(spark, d):
    gammas = table(spark, d, "embeddings").select(F.transform("embedding", lambda e: e.cast("double") + 1).alias("gamma"))
    return T.alpha_statistics(gammas).select("topic", rnd("stat").alias("stat"))


def _documents(spark, d):
    """All words of all documents; any document too wide for a task apart."""
    index = index_corpus(bag(spark, d), 0.0, None)
    normal, wide = M.split_wide(cut_lineage(index.documents))  # read once for their sizes and once to pack them
    return index, M.pack_documents(normal), wide


def _stepped(spark, d, passes=M.INNER_ITER, **options):
    """One E-step under a start model over all documents, those too wide for a task included."""
    index, docs, wide = _documents(spark, d)
    empty = spark.createDataFrame([], "term_id INT, log_beta ARRAY<DOUBLE>")
    step = M.e_step(docs, M.start_alpha(10), empty, index.n_terms, inner_iter=passes, **options)
    if wide is None:
        return step
    return step.unionByName(M.wide_e_step(wide, M.start_alpha(10), empty, index.n_terms, passes))


@query(with_sql("order_bag", "line_stats") + """, model AS (SELECT term_id, max(ln(exp(log_stat) / total + 1e-8)) AS b FROM (SELECT *,
    sum(exp(log_stat)) OVER (PARTITION BY topic) + 1e-8 * (SELECT count(*) FROM part) AS total FROM line_stats) GROUP BY 1)
    SELECT doc_no, term AS term_id, """ + sql_rnd("b") + " AS top, CAST(7 AS INTEGER) AS k FROM order_bag JOIN model ON term_id = term")
def lookup_beta(spark, d):
    """Model row of every document term; terms outside the model get start values."""
    items = order_bag(spark, d).withColumnRenamed("term", "term_id")
    n_terms = table(spark, d, "part").count()
    rows = T.lookup_beta(items, T.fill_absent(T.normalize_beta(line_stats(spark, d), n_terms), 7), 7, n_terms)
    return rows.select("doc_no", "term_id", rnd(F.array_max("log_beta")).alias("top"), F.size("log_beta").alias("k"))


@query()
def e_step(spark, d):
    """Posterior and likelihood of every document under a start model."""
    stepped = _stepped(spark, d, want_sums=False)
    rows = stepped.filter("kind = 'doc'")
    return rows.select(F.col("id").alias("doc_no"), rnd("loglik", 4).alias("loglik"), F.posexplode("vec").alias("k", "g")).select(
        "doc_no", "loglik", "k", rnd("g").alias("gamma")
    )


def _pass_ctes(passes: int) -> list[str]:
    """The update rules from tables ``x`` (words), ``b`` (model), ``alpha`` and ``gamma0`` on: ``gamma{p}`` is the
    posterior after ``p`` passes, ``part{p}`` holds the topic shares of each (document, term) in pass ``p`` and
    ``norm{p}`` their sums; ``lik`` is each document's likelihood."""
    ctes = []
    for p in range(1, passes + 1):
        ctes += [
            f"t{p} AS (SELECT doc_no, k, {PSI.replace('q', 'g')} AS t FROM gamma{p - 1})",
            f"part{p} AS (SELECT doc_no, term_id, k, n, t, b * exp(t) AS e FROM x JOIN b USING (term_id) JOIN t{p} USING (doc_no, k))",
            f"norm{p} AS (SELECT doc_no, term_id, sum(e) AS z FROM part{p} GROUP BY ALL)",
            f"gamma{p} AS (SELECT doc_no, k, a + sum(n * e / z) AS g FROM part{p} JOIN norm{p} USING (doc_no, term_id) JOIN alpha USING (k) GROUP BY doc_no, k, a)",
        ]
    last = passes
    prior = "(SELECT lgamma(sum(a)) - sum(lgamma(a)) FROM alpha)"
    ctes += [
        f"spent AS (SELECT doc_no, term_id, n, z, sum(e / z * t) AS s FROM part{last} JOIN norm{last} USING (doc_no, term_id) GROUP BY ALL)",
        "whole AS (SELECT doc_no, sum(n * (ln(z) - s)) AS l FROM spent GROUP BY 1)",
        f"lik AS (SELECT doc_no, {prior} + sum(lgamma(g)) - lgamma(sum(g)) + any_value(l) AS loglik FROM gamma{last} JOIN whole USING (doc_no) GROUP BY 1)",
    ]
    return ctes


def _sql_passes(topics: int, passes: int) -> str:
    """The update rules from the start values on, over all documents, as CTEs of each pass."""
    word = "18446744073709551616::UHUGEINT"  # 64-bit arithmetic
    times = lambda x, c: f"(xor({x}, {x} >> {c[0]})::UHUGEINT * {c[1]}::UHUGEINT % {word})::UBIGINT"
    golden = 0x9E3779B97F4A7C15
    states = ", ".join(f"({k}, {w}, {int(mix(0, w, k))}::UBIGINT)" for k in range(1, topics + 1) for w in (0, 1))
    alphas = ", ".join(f"({k + 1}, {float(a)!r}::DOUBLE)" for k, a in enumerate(M.start_alpha(topics)))
    ctes = [
        "stats AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM bag GROUP BY term)",
        "vocab AS (SELECT row_number() OVER (ORDER BY df DESC, tf DESC, term) AS term_id, term FROM stats)",
        "titles AS (SELECT row_number() OVER (ORDER BY title) AS doc_no, title FROM (SELECT DISTINCT title FROM bag))",
        "x AS (SELECT doc_no, term_id, n FROM bag JOIN vocab USING (term) JOIN titles USING (title))",
        f"alpha AS (SELECT * FROM (VALUES {alphas}) a(k, a))",
        f"states AS (SELECT * FROM (VALUES {states}) s(k, w, s))",
        f"""draws AS (SELECT term_id, k, w, ((term_id::UHUGEINT + {golden}::UHUGEINT + s::UHUGEINT) % {word})::UBIGINT AS z0,
            {times('z0', (30, 0xBF58476D1CE4E5B9))} AS z1, {times('z1', (27, 0x94D049BB133111EB))} AS z2, xor(z2, z2 >> 31) AS z3,
            ((z3 >> 11)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE AS u FROM vocab, states)""",
        "b AS (SELECT term_id, k, sum(CASE w WHEN 0 THEN 2 * u / (SELECT count(*) FROM vocab) ELSE u END) AS b FROM draws GROUP BY ALL)",
        f"gamma0 AS (SELECT doc_no, k, a + words / {topics} AS g FROM (SELECT doc_no, sum(n)::DOUBLE AS words FROM x GROUP BY 1), alpha)",
    ]
    return with_sql("bag") + ", " + ", ".join(ctes + _pass_ctes(passes))


def _few_passes(spark, d, **options):
    return _stepped(spark, d, 3, **options)


@query(_sql_passes(10, 3) + " SELECT doc_no, " + sql_rnd("loglik", 2) + " AS loglik, CAST(k - 1 AS INTEGER) AS k, " + sql_rnd("g", 3)
       + " AS gamma FROM gamma3 JOIN lik USING (doc_no)")
def e_step_passes(spark, d):
    """Posterior and likelihood of every document after three passes under the start model."""
    rows = _few_passes(spark, d, want_sums=False).filter("kind = 'doc'")
    return rows.select(F.col("id").alias("doc_no"), rnd("loglik", 2).alias("loglik"), F.posexplode("vec").alias("k", "g")).select(
        "doc_no", "loglik", "k", rnd("g", 3).alias("gamma")
    )


@query(_sql_passes(10, 3) + """, sums AS (SELECT term_id, k, sum(n * e / z) AS s FROM part3 JOIN norm3 USING (doc_no, term_id) GROUP BY ALL),
    totals AS (SELECT k, sum(s) AS total FROM sums GROUP BY 1), size AS (SELECT round(count(*) / 10) AS v FROM sums WHERE s > 0)
    SELECT CAST(k AS INTEGER) AS topic, CAST(term_id AS INTEGER) AS term_id, """ + sql_rnd("ln(s / (total + 1e-8 * v) + 1e-8)", 4) + """ AS log_beta
    FROM sums JOIN totals USING (k), size""")
def m_step_passes(spark, d):
    """Beta after one round of three passes over all documents."""
    beta, _ = M.m_step_beta(cut_lineage(_few_passes(spark, d, want_docs=False)), 10)
    return M.beta_long(beta).select("topic", "term_id", rnd("log_beta", 4).alias("log_beta"))


@query(_sql_passes(10, 3) + " SELECT " + sql_rnd("sum(loglik)", 0) + " AS loglik, count(*) AS n_docs FROM lik")
def log_likelihood_passes(spark, d):
    found = _few_passes(spark, d, want_sums=False).filter("kind = 'doc'")
    return T.corpus_log_likelihood(found).select(rnd("loglik", 0).alias("loglik"), "n_docs")


@query()
def train_lda_symmetric(spark, d):
    """Rounds with one alpha for all topics."""
    _, _, model = _trained(spark, d, symmetric=True)
    rows = [(k + 1, float(a)) for k, a in enumerate(model.alpha)]
    return spark.createDataFrame(rows, "topic INT, alpha DOUBLE").select("topic", rnd("alpha").alias("alpha"))


@query()
def corpus_log_likelihood(spark, d):
    stepped = _stepped(spark, d, want_sums=False)
    return T.corpus_log_likelihood(stepped.filter("kind = 'doc'")).select(rnd("loglik", 2).alias("loglik"), "n_docs")


@query()
def m_step_beta(spark, d):
    """Beta after one round over the documents."""
    stepped = M.cut_lineage(_stepped(spark, d, want_docs=False))
    beta, _ = M.m_step_beta(stepped, 10)
    return M.beta_long(beta).select("topic", "term_id", rnd("log_beta").alias("log_beta"))


#: Training stops when the likelihood moves by less than this part; a document's passes when no value of its posterior does.
SETTLED = {"tol": 1e-4, "inner_tol": 1e-3}


def _trained(spark, d, **options):
    """Training on all documents, up to the default rounds; any too wide for a task are kept in long form."""
    index, docs, wide = _documents(spark, d)
    return index, docs, M.train_lda(docs, 10, index.n_terms, wide=wide, **SETTLED, **options)


@query()
def train_lda(spark, d):
    """Alternating rounds on the documents: the ten best words of every topic."""
    index, _, model = _trained(spark, d)
    best = T.top_terms(M.beta_long(model.beta), index.terms.select(F.col("term_id").cast("int"), "term"), 10)
    return best.select("topic", "rank", "term_id", "term", rnd("log_beta").alias("log_beta"))


@query()
def train_lda_with_seeds(spark, d):
    """Training with seed words, truncated topics and random start posteriors."""
    from topiclens.catalog.corpus_queries import seeds
    from topiclens.operators.corpus import seed_words_to_ids

    index, docs, wide = _documents(spark, d)
    prior = seed_words_to_ids(seeds(spark, d), index.terms)
    model = M.train_lda(docs, 10, index.n_terms, tol=1e-3, inner_tol=1e-3, seeds=prior, truncate=1000, truncate_from=1, random_start=True, wide=wide)
    rows = [(k + 1, float(a)) for k, a in enumerate(model.alpha)]
    alpha = spark.createDataFrame(rows, "topic INT, alpha DOUBLE")
    sizes = M.beta_long(model.beta).groupBy("topic").agg(F.count("*").alias("n_terms"), rnd(F.sum(F.exp("log_beta"))).alias("mass"))
    return sizes.join(alpha.select("topic", rnd("alpha").alias("alpha")), "topic")


def _inferred(spark, d, passes=M.INNER_ITER):
    """Order documents under a model of order lines; any too wide for a task in vocabulary blocks."""
    bag_of_orders = cut_lineage(order_bag(spark, d).select("doc_no", F.col("term").alias("term_id"), "n"))  # read for its sizes and to be packed
    normal, wide = M.split_wide(bag_of_orders)
    docs, stats = M.pack_documents(normal), cut_lineage(line_stats(spark, d))
    n_terms = stats.select("term_id").distinct().count()
    rows = T.fill_absent(T.normalize_beta(stats, n_terms), 7).select(F.col("term_id").cast("int").alias("term_id"), "log_beta")
    rows = cut_lineage(rows)  # counted, then sent or written for the tasks
    return M.infer_lda(docs, M.TopicModel(np.full(7, 0.5), rows, n_terms, docs, [], 0), passes, wide=wide)


@query()
def infer_lda(spark, d):
    """Held-out mode: order documents under a model of order lines."""
    found = _inferred(spark, d)
    return found.filter("kind = 'doc'").select(
        F.col("id").alias("doc_no"), rnd("loglik", 4).alias("loglik"), F.array_position("vec", F.array_max("vec")).alias("topic")
    )


INFER_PASSES = 5
_HELD_OUT = with_sql("order_bag", "line_stats") + """, x AS (SELECT doc_no, term AS term_id, n FROM order_bag),
    norms AS (SELECT topic, sum(exp(log_stat)) + 1e-8 * (SELECT count(DISTINCT term_id) FROM line_stats) AS total FROM line_stats GROUP BY 1),
    b AS (SELECT k.topic AS k, t.term_id, coalesce(exp(log_stat) / k.total, 0) + 1e-8 AS b FROM norms k CROSS JOIN (SELECT DISTINCT term_id FROM line_stats) t
        LEFT JOIN line_stats s ON s.topic = k.topic AND s.term_id = t.term_id),
    alpha AS (SELECT topic AS k, 0.5::DOUBLE AS a FROM norms),
    gamma0 AS (SELECT doc_no, k, a + words / 7 AS g FROM (SELECT doc_no, sum(n)::DOUBLE AS words FROM x GROUP BY 1), alpha), """ + ", ".join(_pass_ctes(INFER_PASSES))


@query(_HELD_OUT + f" SELECT doc_no, {sql_rnd('loglik', 4)} AS loglik, CAST(k - 1 AS INTEGER) AS k, {sql_rnd('g', 5)} AS gamma FROM gamma{INFER_PASSES} JOIN lik USING (doc_no)")
def infer_lda_passes(spark, d):
    """Posterior and likelihood of every held-out order after five passes."""
    rows = _inferred(spark, d, INFER_PASSES).filter("kind = 'doc'")
    return rows.select(F.col("id").alias("doc_no"), rnd("loglik", 4).alias("loglik"), F.posexplode("vec").alias("k", "g")).select(
        "doc_no", "loglik", "k", rnd("g", 5).alias("gamma")
    )


@query(_HELD_OUT + f" SELECT doc_no, CAST(term_id AS INTEGER) AS term_id, n::DOUBLE AS n, CAST(k - 1 AS INTEGER) AS k, {sql_rnd('e / z', 5)} AS phi FROM part{INFER_PASSES} JOIN norm{INFER_PASSES} USING (doc_no, term_id)")
def infer_phi_passes(spark, d):
    """Topic shares of every term of every held-out order in the fifth pass."""
    found = M.phi_rows(_inferred(spark, d, INFER_PASSES))
    return found.select("doc_no", "term_id", "n", F.posexplode("log_phi").alias("k", "p")).select("doc_no", "term_id", "n", "k", rnd(F.exp("p"), 5).alias("phi"))


@query()
def infer_phi(spark, d):
    """Topic probabilities of every term of every held-out order."""
    return M.phi_rows(_inferred(spark, d)).select("doc_no", "term_id", "n", S.label_from_probability("log_phi", 0.7).alias("label"))


@query()
def resume_training(spark, d):
    """Two rounds, a snapshot, and the other rounds from it."""
    path = scratch(spark, "model")
    _, _, model = _trained(spark, d, max_iter=2)
    M.save_model(model, path)
    M.discard_model(model)
    resumed = M.resume_training(spark, path, 2, 30, **SETTLED)
    rows = [(k + 1, float(a)) for k, a in enumerate(resumed.alpha)]
    return spark.createDataFrame(rows, "topic INT, alpha DOUBLE").select("topic", rnd("alpha").alias("alpha"))


@query()
def wide_documents(spark, d):
    """Posterior by grouped sums, for documents too wide for a task: the conversations' words by role."""
    talk = table(spark, d, "conversations")
    from topiclens.operators.corpus import bag_of_words

    words = bag_of_words(talk.select("role", "text"), "role")
    index = index_corpus(words.withColumnRenamed("role", "title"), 0.0, None)
    empty = spark.createDataFrame([], "term_id INT, log_beta ARRAY<DOUBLE>")
    stepped = M.wide_e_step(index.documents, M.start_alpha(4), empty, index.n_terms, tol=0.1).filter("kind = 'doc'")
    return stepped.select(F.col("id").alias("doc_no"), F.posexplode("vec").alias("k", "g")).select("doc_no", "k", rnd("g", 4).alias("gamma"))


SPATIAL_K = 4
_PSI_OF = lambda name: PSI.replace("q", name)


def _spatial_sql(reach: float | None) -> str:
    near = "true" if reach is None else f"d2 <= {reach * reach}"
    return with_sql("patches", "centers", "assigned") + f""", topics AS (SELECT CAST(k AS INTEGER) AS k FROM range(1, {SPATIAL_K + 1}) t(k)),
    xi AS (SELECT image_id, vec_id AS patch_id, x, y, code AS term_id, k, ("desc"[k] + 2) / list_sum(list_transform("desc"[1:{SPATIAL_K}], lambda v: v + 2)) AS xi
        FROM assigned, topics),
    places AS (SELECT DISTINCT image_id, CAST(gy * 4 + gx AS INTEGER) AS region_id, 5.0 + 10 * gx AS x, 5.0 + 10 * gy AS y FROM patches, range(4) a(gx), range(3) b(gy)),
    start AS (SELECT *, 1 + ((region_id + k) % 3) * 0.5 AS g FROM places, topics),
    gammas AS (SELECT *, sum(g) OVER (PARTITION BY image_id, region_id) AS total FROM start),
    elog AS (SELECT image_id, region_id, x, y, k, {_PSI_OF('g')} - ({_PSI_OF('total')}) AS e FROM gammas),
    weights AS (SELECT term_id, k, 1 + ((term_id * k) % 5) * 0.2 AS w FROM (SELECT DISTINCT code AS term_id FROM assigned), topics),
    sums AS (SELECT *, sum(w) OVER (PARTITION BY k) AS total FROM weights),
    word AS (SELECT term_id, k, {_PSI_OF('w')} - ({_PSI_OF('total')}) AS e FROM sums),
    logits AS (SELECT xi.image_id, patch_id, region_id, sum(xi * e) - any_value(d2) / 100 AS l FROM (SELECT xi.*, e.region_id, e.e,
        pow(xi.x - e.x, 2) + pow(xi.y - e.y, 2) AS d2 FROM xi JOIN elog e ON xi.image_id = e.image_id AND xi.k = e.k) xi WHERE {near} GROUP BY ALL),
    rho AS (SELECT image_id, patch_id, region_id, exp(l) / sum(exp(l)) OVER (PARTITION BY image_id, patch_id) AS rho FROM logits),
    pull AS (SELECT r.image_id, patch_id, k, sum(rho * e) AS pull FROM rho r JOIN elog e ON r.image_id = e.image_id AND r.region_id = e.region_id GROUP BY ALL),
    raw AS (SELECT xi.*, exp(pull + w.e) AS v FROM xi JOIN pull USING (image_id, patch_id, k) JOIN word w ON w.term_id = xi.term_id AND w.k = xi.k),
    moved AS (SELECT *, v / sum(v) OVER (PARTITION BY image_id, patch_id) AS new_xi FROM raw)
    """


def _spatial_step(spark, d, reach):
    """One step from topics read off the descriptors, over a grid of regions every 10 pixels."""
    codes, _ = code_table(spark, d)
    topics = range(1, SPATIAL_K + 1)
    head = F.transform(F.slice("desc", 1, SPATIAL_K), lambda v: v + 2)
    patches = codes.select(
        "image_id", F.col("vec_id").alias("patch_id"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("code").alias("term_id"),
        F.transform(head, lambda v: v / F.aggregate(head, F.lit(0.0), lambda s, e: s + e)).alias("xi"),
    )
    grid = P.region_grid(mosaic_sizes(spark, d), 10)
    regions = grid.withColumn("gamma", F.array(*(F.lit(1.0) + (F.col("region_id") + k) % 3 * 0.5 for k in topics)))
    terms = codes.select(F.col("code").alias("term_id")).distinct().withColumn("weight", F.array(*(F.lit(1.0) + F.col("term_id") * k % 5 * 0.2 for k in topics)))
    return P.spatial_lda_step(P.SpatialState(patches, regions, terms), [0.5] * SPATIAL_K, 0.1, 10.0, reach)


def _by_topic(df, keys, vector, name):
    long = df.select(*keys, F.posexplode(vector).alias("k", name))
    return long.select(*keys, (F.col("k") + 1).alias("topic"), rnd(name).alias(name))


@query(_spatial_sql(None) + "SELECT p.image_id, p.region_id, p.k AS topic, " + sql_rnd("0.5 + coalesce(sum(rho * new_xi), 0)") + """ AS gamma FROM start p
    LEFT JOIN rho r ON p.image_id = r.image_id AND p.region_id = r.region_id LEFT JOIN moved m ON m.image_id = r.image_id AND m.patch_id = r.patch_id AND m.k = p.k GROUP BY 1, 2, 3""")
def spatial_lda_step(spark, d):
    """Topics of every region after a step in which patches choose among all regions of their image."""
    return _by_topic(_spatial_step(spark, d, None).regions, ["image_id", "region_id"], "gamma", "gamma")


@query(_spatial_sql(None) + "SELECT term_id, k AS topic, " + sql_rnd("0.1 + sum(new_xi)") + " AS weight FROM moved GROUP BY 1, 2")
def spatial_lda_words(spark, d):
    """Topics of every word after the same step."""
    return _by_topic(_spatial_step(spark, d, None).terms, ["term_id"], "weight", "weight")


@query(_spatial_sql(12.0) + """, best AS (SELECT image_id, patch_id, arg_max(region_id, (round(rho, 9), -region_id)) AS region_id, max(rho) AS rho FROM rho GROUP BY 1, 2)
    SELECT m.image_id, m.patch_id, k AS topic, """ + sql_rnd("new_xi") + " AS xi, b.region_id, " + sql_rnd("b.rho") + " AS rho FROM moved m JOIN best b USING (image_id, patch_id)")
def spatial_lda_near(spark, d):
    """Topics and region of every patch when only regions within 12 pixels count."""
    patches = _spatial_step(spark, d, 12.0).patches
    return _by_topic(patches, ["image_id", "patch_id", "region_id", rnd("rho").alias("rho")], "xi", "xi")
