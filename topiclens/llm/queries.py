"""The numbered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.llm.chat import pack_conversations, read_conversations
from topiclens.llm.common import ascii_lower, read
from topiclens.llm.decontamination import find_leaks
from topiclens.llm.exact_dedup import exact_dedup
from topiclens.llm.licenses import LICENSE_WORD, TEMPLATES, license_scan
from topiclens.llm.line_dedup import drop_lines
from topiclens.llm.merkle import folded, leaf_digest, merkle_manifest
from topiclens.llm.mixing import mix
from topiclens.llm.simhash import simhash_groups
from topiclens.llm.substring_dedup import substring_dedup
from topiclens.llm.token_files import read_token_files, write_token_files
from topiclens.llm.toxicity import toxicity
from topiclens.llm.vantage import cluster_vectors
from topiclens.llm.warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# DuckDB spellings of the shared definitions
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash_groups(read(spark, sf_dir, "documents"), k=4, radius=4)


@query(
    f"""
    WITH sizes AS (
      SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
      FROM documents
    ), per_source AS (
      SELECT source, sum(size)::BIGINT AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
      FROM sizes GROUP BY source
    ), filling AS (
      SELECT *, sum(s) OVER ()::DOUBLE * 1.5 AS budget,
             coalesce(sum(2.0::DOUBLE * s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
             sum(w) OVER (ORDER BY s / w DESC, source DESC NULLS FIRST)::DOUBLE AS weighing
      FROM per_source
    ), level AS (
      SELECT spent, weighing FROM filling WHERE (budget - spent) * w / weighing <= 2.0::DOUBLE * s ORDER BY s / w, source NULLS LAST LIMIT 1
    ), targets AS (
      SELECT source, s, CASE WHEN level.spent IS NULL OR (budget - level.spent) * w / level.weighing > 2.0::DOUBLE * s THEN 2.0::DOUBLE * s
                             ELSE (budget - level.spent) * w / level.weighing END AS target
      FROM filling LEFT JOIN level ON true
    ), plan AS (
      SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS times FROM targets
    ), units AS (
      SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sizes WHERE size > 0 GROUP BY source, h
    ), chosen AS (
      SELECT u.source, u.h, u.upto < rest OR (u.upto - u.n < rest AND u.upto - rest <= rest - (u.upto - u.n)) AS taken
      FROM units u JOIN (SELECT source, target - times * s AS rest FROM plan) p ON u.source IS NOT DISTINCT FROM p.source
      WHERE rest > 0
    )
    SELECT d.doc_id, d.size, p.s AS source_size, p.target,
           (d.size * (p.times + CASE WHEN c.taken THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM sizes d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
    LEFT JOIN chosen c ON c.h = d.h AND c.source IS NOT DISTINCT FROM d.source
    """
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: words each gives to its source's target."""
    return mix(read(spark, sf_dir, "documents")).drop("copies")


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup(read(spark, sf_dir, "documents"))


@query(
    r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ), shown AS (
      SELECT *, 12 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
                + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 10 + 1 AS chars
      FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id
    """
)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, packed as a prefix tree and read back."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text"))
        for i, role in enumerate(["user", "assistant"])
    ))))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_conversations(*pack_conversations(turns.unionByName(extra), tokenizer), tokenizer)


@query(
    f"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), keyed AS (
      SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines
    ), frequent AS (
      SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
      SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    kept = drop_lines(read(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), tokenizer, end_id=1))


@query(
    f"""
    WITH docs AS (
      SELECT doc_id, {_WORDS} AS w FROM documents
    ), windows AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS x FROM docs, range(1, len(w) - 33) r(i)
    ), repeated AS (
      SELECT md5(x) AS x FROM windows GROUP BY ALL HAVING count(*) > 1
    ), starts AS (
      SELECT doc_id, i FROM windows SEMI JOIN repeated ON md5(windows.x) = repeated.x
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM starts
    ), word_rows AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
    ), kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word_rows ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
    """
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words and more that stand elsewhere."""
    kept = substring_dedup(read(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, at its most similar window."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_print")


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def _license_sql() -> str:
    """Every place where all key phrases of a template stand, by plain search."""
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    rows = []
    for number, t in enumerate(TEMPLATES):
        spans = t.key_spans()
        stand = " AND ".join(f"list_slice(w, i + {at - spans[0][0]}, i + {at - spans[0][0] + len(own) - 1}) = {text(own)}" for at, own in spans)
        rows.append(
            f"SELECT doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, i - 1 - {spans[0][0]} AS start, {text(t.words)} AS t, w "
            f"FROM places JOIN docs USING (doc_id) WHERE word = '{spans[0][1][0]}' AND {stand}"
        )
    return rf"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), places AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
    ), found AS (
      {" UNION ALL ".join(rows)}
    ), shared AS (
      SELECT *, len(list_filter(range(len(t)), lambda j: start + j >= 0 AND w[start + j + 1] IS NOT DISTINCT FROM t[j + 1])) / len(t) AS share FROM found
    ), summed AS (
      SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
      FROM shared GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
    FROM docs d LEFT JOIN summed USING (doc_id)
    """


@query(_license_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return license_scan(read(spark, sf_dir, "documents"))


@query(
    """
    WITH payloads AS (
      SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
    ), kept AS (
      SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS largest FROM payloads
    )
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN largest <> page_id THEN largest END AS refers_to
    FROM kept
    """
)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, in segments where long, and read back."""
    back = read_warc(write_warc(read(spark, sf_dir, "pages"), revisit_bytes=1000), with_payload=False)
    checked = F.when(F.col("status") == "ok", F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("record "), "record_id", F.lit(": "), "status")).cast("bigint"))
    return back.select(
        F.col("page_id").cast("long").alias("page_id"), checked.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def _merkle_sql(levels: int = 8, over: int = 3) -> str:
    """The trees level by level: up to 8 ** ``levels`` documents of a language, 8 ** ``over`` languages."""

    def tree(name: str, group: str, height: int) -> str:
        steps = []
        for at in range(height):
            steps.append(
                f"{name}_run{at} AS (SELECT {group}, i // 8 AS i, list(d ORDER BY i) AS run, any_value(n) AS n FROM {name}{at} GROUP BY {group}, i // 8)"
            )
            steps.append(
                f"{name}{at + 1} AS (SELECT {group}, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d, (n + 7) // 8 AS n FROM {name}_run{at})"
            )
        return ", ".join(steps)

    def path(name: str, group: str, height: int, source: str) -> tuple[str, str]:
        joins = " ".join(f"JOIN {name}_run{at} r{at} ON r{at}.{group} = s.{group} AND r{at}.i = s.i // {8 ** (at + 1)}" for at in range(height))
        pairs = ", ".join(
            f"{{'a': CASE WHEN r{at}.n > 1 THEN array_to_string(r{at}.run[1:(s.i // {8**at} % 8)], '') ELSE '' END, "
            f"'b': CASE WHEN r{at}.n > 1 THEN array_to_string(r{at}.run[(s.i // {8**at} % 8 + 2):], '') ELSE '' END, 'up': r{at}.n > 1}}"
            for at in range(height)
        )
        return f"[{pairs}]", f"{source} s {joins}"

    low, low_from = path("t", "lang", levels, "named")
    high, high_from = path("u", "g", over, "u0")
    shown = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(shown, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # crc32 of the decimal id by its table of 256 remainders
    crc_table = "[" + ", ".join(str(_crc_entry(b)) for b in range(256)) + "]"
    crc = (
        "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
        f"lambda crc, c: xor({crc_table}[((xor(crc, c)) & 255) + 1], crc >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"
    )
    fold = lambda parts, start: f"list_reduce({parts}, lambda below, x: CASE WHEN x.up THEN {{'a': '', 'b': '', 'up': true, 'd': sha256(x.a || below.d || x.b)}} ELSE below END, {start})"
    return f"""
    WITH docs AS (
      SELECT doc_id, '=' || lang AS named, {leaf('text')} AS leaf,
             CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, " + _LOWER + ")")} ELSE {leaf('text')} END AS changed
      FROM documents
    ), named AS (
      SELECT doc_id, coalesce(named, '') AS lang, leaf, changed, leaf AS d,
             row_number() OVER (PARTITION BY coalesce(named, '') ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY coalesce(named, '')) AS n
      FROM docs
    ), t0 AS (
      SELECT lang, i, d, n FROM named
    ), {tree("t", "lang", levels)}, u0 AS (
      SELECT 0 AS g, lang, row_number() OVER (ORDER BY lang) - 1 AS i, d, count(*) OVER () AS n FROM t{levels}
    ), {tree("u", "g", over)}, above AS (
      SELECT s.lang, s.d AS subroot, {high} AS parts FROM {high_from}
    ), below AS (
      SELECT s.doc_id, s.lang, s.leaf, s.changed, {low} AS parts FROM {low_from}
    ), proofs AS (
      SELECT doc_id, leaf, changed, subroot, u{over}.d AS root, list_transform(below.parts || above.parts, lambda x: {{'a': x.a, 'b': x.b, 'up': x.up, 'd': ''}}) AS parts
      FROM below JOIN above USING (lang) CROSS JOIN u{over}
    ), ended AS (
      SELECT *, {fold("parts", "{'a': '', 'b': '', 'up': true, 'd': changed}")}.d AS folded_root FROM proofs
    )
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(parts, lambda x: x.a || x.b), '')) AS proof_sha256,
           folded_root, folded_root = root AS verified FROM ended
    """


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


@query(_merkle_sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, checked against a third of texts tampered with."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), ascii_lower(F.col("text"))))
    made = merkle_manifest(docs.withColumn("changed", changed), carry=["changed"])
    made = made.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and floored means, one after the other."""
    away = "list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::BIGINT"
    nearest = lambda at: (
        f"SELECT v.rid, arg_min({{'c': c.c, 'd': {away}}}, {{'d': {away}, 'c': c.c}}) AS best FROM kept v CROSS JOIN c{at} c GROUP BY v.rid"
    )
    steps = []
    for at in range(rounds):
        steps.append(f"a{at} AS MATERIALIZED ({nearest(at)})")
        steps.append(
            f"m{at} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM (SELECT best.c AS c, j, sum(q[j])::HUGEINT AS s, count(*)::HUGEINT AS n "
            f"FROM kept JOIN a{at} USING (rid), range(1, 65) r(j) GROUP BY best.c, j) GROUP BY c)"
        )
        steps.append(f"c{at + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{at} o LEFT JOIN m{at} m USING (c))")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY vec_id IS NULL, sha256('3:' || vec_id::VARCHAR), q) - 1)::INT AS c, q FROM kept
      ORDER BY vec_id IS NULL, sha256('3:' || vec_id::VARCHAR), q LIMIT {k}
    ), {", ".join(steps)}, last AS MATERIALIZED ({nearest(rounds)})
    SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
           (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM last JOIN kept USING (rid) JOIN c{rounds} c ON c.c = best.c
    """


@query(_kmeans_sql())
def op13_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds over eight centroids."""
    found = cluster_vectors(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")
