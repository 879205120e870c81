"""The thin queries over whole tables that apply the operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._shared import documents
from auditlake.llm.ann import nearest
from auditlake.llm.fingerprint import fingerprint_documents
from auditlake.llm.lexical_search import search
from auditlake.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from auditlake.llm.line_dedup import dedup_lines
from auditlake.llm.lm_score import score_documents
from auditlake.llm.near_dedup import near_duplicates
from auditlake.llm.packing import pack_documents
from auditlake.llm.secret_scan import ACCESS, ASSIGN, BARE, HEX, KINDS, LEAST, MIXED, PLACEHOLDERS, scan_secrets
from auditlake.llm.sentencepiece_scan import decode_documents, encode_documents
from auditlake.llm.substring_dedup import dedup_substrings
from auditlake.llm.toxicity import score_toxicity
from auditlake.llm.whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(ls) - 2)) AS pos, ls FROM lines WHERE len(ls) >= 3
), keyed AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w FROM windows
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS occurrence FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE occurrence > 1
), flat AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines
), kept AS (
  SELECT f.doc_id, count(g.pos) AS n, string_agg(f.line, chr(10) ORDER BY f.pos) FILTER (WHERE g.pos IS NULL) AS t
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY f.doc_id
)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lines l LEFT JOIN kept USING (doc_id)
"""


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _license_sql() -> str:
    templates = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))!r}, {share})" for i, (label, t, share) in enumerate(TEMPLATES))
    cases = " UNION ALL ".join(
        f"SELECT doc_id, p, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM words) WHERE "
        + " AND ".join(f"w[p + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), places AS ({cases}),
templates(t, label, tw, share) AS (VALUES {templates}),
known AS (SELECT list(DISTINCT x) AS ws FROM (SELECT unnest(tw) AS x FROM templates)),
blocks AS (
  SELECT doc_id, list_intersect(w[s * 32 + 1 : s * 32 + 64], known.ws) AS b
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0) // 32 + 1)) AS s FROM words), known
), matched AS (
  SELECT doc_id, label, len(list_intersect(b, tw)) AS shared, len(tw) AS n, share FROM blocks, templates
  WHERE len(b) >= ceil(share * len(tw) - 1e-9)
), labelled AS (
  SELECT doc_id, label, shared / n AS score FROM matched WHERE shared >= ceil(share * n - 1e-9)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM labelled) GROUP BY doc_id
), best AS (SELECT doc_id, max(score) AS score FROM labelled GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLES["op2_license_scan"] = _license_sql()


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words are those between separators, so the digest doesn't depend on which texts lost any."""
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(spaced, 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(len(w) - 12)) AS p, w FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, p, md5_number(array_to_string(w[p + 1 : p + 13], ' ')) AS h FROM starts
), firsts AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, p + unnest(range(13)) AS p FROM firsts WHERE first_doc < doc_id
), removed AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS t FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


ORACLES["op8_near_dedup"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s
  FROM words
), sets AS (SELECT doc_id, s, len(s) AS n FROM shingled),
items AS (SELECT doc_id, n, md5_number(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT ways.b, reach.r FROM reach JOIN ways ON reach.doc_id = ways.a WHERE reach.r < ways.b
)
SELECT doc_id, any_value(sets.n)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


@_query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLES["op10_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document."""
    out = pack_documents(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens", F.explode("pieces").alias("p"))
    return out.select("doc_id", "n_tokens", "p.piece", "p.bin_id", "p.capacity", F.col("p.at").alias("bin_offset"), F.col("p.n").alias("piece_tokens"))


@_query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


@_query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), SENTENCEPIECE_MODEL)
    digest = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "token_score", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    decoded = decode_documents(digest, SENTENCEPIECE_MODEL)
    return decoded.select("doc_id", "n_tokens", "token_score", "ids_sha256", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source owns its documents; its texts in one language are a repository."""
    out = scan_secrets(documents(spark, sf_dir), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id",
        *(count("kind", kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "bare")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        *(count("verdict", verdict).alias(f"n_{verdict}") for verdict in ("live", "example", "plain")),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0).cast("long")).alias("most_owners"),
    )


def _secret_sql() -> str:
    """Base kinds and bare tokens one by one, values counted by owner, spans judged and listed."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    wanted = {k: f"length(v) >= {n}" for k, n in LEAST.items()}
    wanted["bare"] = f"regexp_full_match(v, '{MIXED}') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND NOT regexp_full_match(v, '{ACCESS}|{HEX}')"
    holds = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "bare": MIXED}
    cases = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, {i} AS k, '{kind}' AS kind, regexp_extract_all(t, {quoted(p)}) AS ms, "
        f"{f'regexp_extract_all(t, {quoted(p)}, 2)' if kind == 'assign' else f'regexp_extract_all(t, {quoted(p)})'} AS vs, string_split_regex(t, {quoted(p)}) AS gs "
        f"FROM texts WHERE regexp_matches(t, {quoted(holds[kind])})"
        for i, (kind, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE)))
    )
    keep = " OR ".join(f"(kind = '{k}' AND {c})" for k, c in wanted.items())
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({cases}),
placed AS (
  SELECT doc_id, source, lang, k, kind, i, vs[i] AS v, length(ms[i]) AS n,
         list_sum(list_transform(gs[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS e
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)
), spans AS (SELECT *, (e - n)::BIGINT AS s, sha256(v) AS h FROM placed WHERE {keep}),
owned AS (
  SELECT h, count(DISTINCT coalesce(source, '?')) AS owners FROM spans GROUP BY h
), judged AS (
  SELECT spans.*, e::BIGINT AS stop, owners, CASE WHEN regexp_matches(translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PLACEHOLDERS)}') OR owners > 2 THEN 'example'
         WHEN len(list_distinct(string_split(v, ''))) >= 10 THEN 'live' ELSE 'plain' END AS verdict
  FROM spans JOIN owned USING (h)
), listed AS (
  SELECT doc_id, kind, k, s, stop AS e, verdict, owners FROM judged WHERE kind <> 'bare' OR verdict = 'live'
), by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         {listed} FILTER (WHERE k < 3) AS base, {listed} AS spans, max(owners) AS most,
         count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example, count(*) FILTER (WHERE verdict = 'plain') AS n_plain
  FROM listed GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_plain, 0) AS n_plain, coalesce(most, 0) AS most_owners
FROM documents LEFT JOIN by_doc USING (doc_id)
"""


ORACLES["op11_secret_scan"] = _secret_sql()


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op13_lexical_search"] = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), docs AS (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_words FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(all_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_words))) AS c FROM counts JOIN weights USING (term), total
), scores AS (
  SELECT item_id, doc_id, sum(c)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id HAVING sum(c) > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
