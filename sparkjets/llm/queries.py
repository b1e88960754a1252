"""The dealt operators as queries over the given tables, each beside its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkjets.llm import (
    chunk_bpe,
    cover_search,
    embedding_dups,
    importance,
    license_join,
    multi_index,
    near_dups,
    packed_ids,
    packing,
    resharding,
    rule_ledger,
    term_grid,
    token_counts,
)
from sparkjets.llm.common import keep, table, text_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_cover_tree_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
)
def op1_cover_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose id is divisible by 100."""
    return cover_search.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, 10)


@query("op2_packed_ids")
def op2_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a packed token file: doc_id, start, n_tokens, ids_crc32."""
    path = packed_ids.write_packed(table(spark, folder, "documents"))
    return packed_ids.read_documents(spark, path)


@query("op3_chunk_reuse_bpe")
def op3_chunk_reuse_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of encoded and decoded texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return chunk_bpe.digests(table(spark, folder, "documents"))


@query(
    "op4_chosen_path",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN ws ELSE ws[i : i + 3] END AS x
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id
        GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
        WHERE 100 * k >= 80 * (x.n + y.n - k)),
    reach AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents
        UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a) SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
    """,
)
def op4_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents: doc_id, n_shingles, component_id, kept."""
    return near_dups.near_duplicates(table(spark, folder, "documents"), words=4)


#: The old layout that op5 reshards: one shard per hash of the source, of which one holds a third of all rows.
OLD_SHARDS, NEW_SHARDS = 24, 40


@query("op5_flow_resharding")
def op5_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the new shards, read back: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = table(spark, folder, "documents")
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    rows, _ = resharding.reshard(docs, old, NEW_SHARDS)
    read = rows.select(
        "doc_id",
        resharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
    )
    return resharding.with_slots(read).withColumn("grown_shard", F.lit(None).cast("int"))


WORD_SQL = r"[^\x20\x09-\x0D]+"


@query(
    "op6_rule_ledger",
    rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_SQL}') AS ws FROM t),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
        WHERE regexp_matches(line, '{WORD_SQL}') GROUP BY doc_id),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM windows, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
            length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
            coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
    f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
            ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
            + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
            + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
            + 64 * (10 * n_capitals > 3 * word_chars)::BIGINT)::BIGINT AS fail_bits FROM m)
    SELECT *, fail_bits = 0 AS kept, 'standard-1' AS policy FROM f
    """,
)
def op6_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the standard policy for every document."""
    entries = keep(rule_ledger.ledger(table(spark, folder, "documents")), "ledger")
    judged = rule_ledger.apply_policy(entries, rule_ledger.STANDARD)
    return judged.withColumn("base_failed", rule_ledger.fails(rule_ledger.BASE))


@query("op7_separator_scan")
def op7_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts found in flat files without an index: file, ordinal, doc_id, start, n_tokens."""
    path = token_counts.write_flat(table(spark, folder, "documents"))
    counted = token_counts.count_documents(spark, path, token_counts.END_OF_TEXT)
    return counted.join(token_counts.listed_documents(spark, path), ["file", "ordinal"])


@query("op8_configuration_packing")
def op8_configuration_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(table(spark, folder, "documents"))


def _license_sql(runs: bool = False) -> str:
    def quoted(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in license_join.PHRASES.items())
    notices = ", ".join(f"('{label}', {quoted(words)}, {n})" for label, words, n in license_join.notices())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    more = "SELECT doc_id, label, shared, size FROM found WHERE shared >= needed"
    run_tables = ""
    if runs:
        rows = ", ".join(
            f"('{label}', {quoted(words)}, {n}, {reach}, {quoted(named)}::VARCHAR[], {quoted(alien)}::VARCHAR[])"
            for label, words, n, reach, named, alien in license_join.run_notices()
        )
        run_tables = rf"""
    run_notices(label, of_template, needed, reach, named, alien) AS (VALUES {rows}),
    starts AS (SELECT doc_id, r.*, ws[i : i + reach - 1] AS run
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN run_notices r ON list_contains(of_template, ws[i])),
    ends AS (SELECT *, coalesce(list_position(list_transform(run, lambda x: list_contains(alien, x)), true), 0) AS stop FROM starts),
    cut AS (SELECT *, CASE WHEN stop > 0 THEN run[1 : stop - 1] ELSE run END AS own FROM ends),
    in_runs AS (SELECT doc_id, label, len(list_intersect(own, of_template)) AS shared, len(of_template) AS size, needed
        FROM cut WHERE len(list_intersect(own, named)) = len(named)),"""
        more += " UNION ALL SELECT doc_id, label, shared, size FROM in_runs WHERE shared >= needed"
    method = f"({more})" if runs else "found WHERE shared >= needed"
    return rf"""
    WITH t AS (SELECT doc_id, {lower} AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS ws FROM t),{run_tables}
    phrases(p, label) AS (VALUES {phrases}),
    places AS (SELECT doc_id, i - 1 AS place, label
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN phrases ON ws[i : i + len(p) - 1] = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        list(DISTINCT label) AS bl FROM places GROUP BY doc_id),
    notices(label, of_template, needed) AS (VALUES {notices}),
    lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(text, chr(10))), '{word}') AS ws FROM t),
    found AS (SELECT doc_id, label, len(list_intersect(ws, of_template)) AS shared, len(of_template) AS size, needed
        FROM lines, notices),
    method AS (SELECT doc_id, list(DISTINCT label) AS ml, max(round(shared / size, 6)) AS best
        FROM {method} GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
        first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ','), '') AS labels,
        CASE WHEN bl IS NOT NULL THEN 1e0 ELSE coalesce(best, 0e0) END AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
    """


@query("op9_license_join", _license_sql())
def op9_license_join(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return license_join.scan(table(spark, folder, "documents"))


@query("op9_license_blocks", _license_sql(runs=True))
def op9_license_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """As op9_license_join, with blocks that cross line ends and may lack a word."""
    return license_join.scan_blocks(table(spark, folder, "documents"))


@query("op10_importance_resampling")
def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight, Gumbel key and verdict of every document: doc_id, log_weight, key, kept."""
    docs = table(spark, folder, "documents")
    model = importance.fit(docs, table(spark, folder, "labels"))
    weighted = docs.select("doc_id", text_key().alias("text_hash"), model.weight().alias("log_weight"))
    resampled, _ = importance.resample(keep(weighted, "weights"), model.threshold)
    return resampled.select("doc_id", "log_weight", "key", "kept")


@query(
    "op11_multi_index",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, positive_rank FROM (SELECT *,
        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same)
        WHERE positive_rank <= 5)
    SELECT anchor_id, positive_id, positive_rank::INT AS positive_rank, rank::INT AS rank, negative_id, positive_score,
        negative_score
    FROM (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    WHERE rank <= 10
    """,
)
def op11_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every anchor (vectors whose id is divisible by 100)."""
    vectors = table(spark, folder, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(vectors.withColumn("label", noisy), F.col("id") % 100 == 0)


TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_term_grid",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '{TERM_SQL}') AS ts FROM documents WHERE doc_id IS NOT NULL),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER_SQL}, '{TERM_SQL}')) AS term FROM benchmark),
    c AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
    p AS (SELECT doc_id, len(ts)::BIGINT AS n, term, count(*)::BIGINT AS tf
        FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, big_n),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
        FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
    """,
)
def op12_term_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return term_grid.rank(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


@query(
    "op13_embedding_dups",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.q, b.q) >= 0.9),
    n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
    reach AS (WITH RECURSIVE r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings
        UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.c = e.a) SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
    FROM embeddings LEFT JOIN n ON vec_id = a JOIN reach USING (vec_id)
    """,
)
def op13_embedding_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate embeddings: vec_id, n_links, component_id, kept."""
    return embedding_dups.near_duplicates(table(spark, folder, "embeddings"))
