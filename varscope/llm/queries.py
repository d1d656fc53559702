"""One query per operator, over its whole table, in the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import functions as F

from varscope.llm.divergence import audit_divergence
from varscope.llm.embedding_dedup import link_embeddings
from varscope.llm.exact_dedup import exact_dedup
from varscope.llm.filter_audit import audit_filters, corpus_filters
from varscope.llm.language_id import fit_languages, identify_languages
from varscope.llm.common import crc_fold, new_path
from varscope.llm.minhash_forest import near_copies
from varscope.llm.mixing import mix_sources
from varscope.llm.packing import pack_documents
from varscope.llm.registry import ORACLES, QUERIES, query, table
from varscope.llm.secrets import BASE_KINDS, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LEAST_ENTROPY, OWNED, scan_secrets
from varscope.llm.sharding import shuffle_into_shards
from varscope.llm.token_files import read_token_files, write_token_files
from varscope.llm.toxicity import fit_toxicity, score_toxicity
from varscope.llm.url_filter import judge_urls

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 40
# Verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id) AS kept
FROM embeddings e"""


@query("op1_int8_tiles", EMBEDDINGS_SQL)
def op1(spark, folder):
    return link_embeddings(table(spark, folder, "embeddings"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    """Spans of one kind: a match starts after the pieces and matches before it."""
    return f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, place AS "start", place + length(whole) AS "end", value
  FROM (SELECT *, sum(length(piece)) OVER o + coalesce(sum(length(whole)) OVER (
      PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM (SELECT doc_id, source, unnest(range(len(w))) AS n, unnest(w) AS whole, unnest(v) AS value, unnest(p[1:len(w)]) AS piece
      FROM (SELECT doc_id, source, regexp_extract_all(text, $q${pattern}$q$) AS w,
          regexp_extract_all(text, $q${pattern}$q$, {group}) AS v, regexp_split_to_array(text, $q${pattern}$q$) AS p
        FROM documents WHERE text IS NOT NULL)) WINDOW o AS (PARTITION BY doc_id ORDER BY n))
  WHERE length(value) >= {least} AND {more}"""


SECRETS_SQL = f"""
WITH base AS ({" UNION ALL ".join(_sql_spans(k, n, p, g, m) for n, (k, p, g, m) in enumerate(BASE_KINDS))}),
loose AS ({_sql_spans(OWNED[0], 3, *OWNED[1:], more="regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")}),
letters AS (SELECT value, c, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS c
  FROM (SELECT DISTINCT value FROM loose)) GROUP BY ALL),
busy AS (SELECT value FROM (SELECT value, n / sum(n) OVER (PARTITION BY value) AS share FROM letters)
  GROUP BY value HAVING sum(-share * log2(share)) >= {LEAST_ENTROPY}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM loose SEMI JOIN busy USING (value)),
examples AS (SELECT value FROM (SELECT DISTINCT value, source, doc_id FROM spans) GROUP BY value
  HAVING count(DISTINCT coalesce(source, chr(0))) >= {EXAMPLE_OWNERS} OR count(*) >= {EXAMPLE_REPOSITORIES}),
kept AS (SELECT *, value IN (SELECT value FROM examples) AS example FROM spans s
  WHERE rank < 3 OR (value NOT IN (SELECT value FROM examples) AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b."start" < s."end" AND s."start" < b."end"))),
told AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
  count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (example) AS n_example,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id"""


@query("op2_secret_ownership", SECRETS_SQL)
def op2(spark, folder):
    found = scan_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("bigint").alias("n_example"))


def public_tokenizer() -> dict:
    """Files of the public byte-level vocabulary."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query("op3_configuration_packing")
def op3(spark, folder):
    return pack_documents(table(spark, folder, "documents"), public_tokenizer(), keep_ids=False)


@query("op4_mix_sources")
def op4(spark, folder):
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_mixture_languages")
def op5(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", crc_fold("doc_id", 4) == 2)
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify_languages(docs, model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


NEAR_COPIES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 2 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id"""


@query("op6_minhash_forest", NEAR_COPIES_SQL)
def op6(spark, folder):
    return near_copies(table(spark, folder, "documents"))


@query("op7_lexicon_automaton")
def op7(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", crc_fold("doc_id", 3) == 1)
    model = fit_toxicity(docs.where(~F.col("held_out")), table(spark, folder, "labels").select("doc_id", "toxic"))
    scored = score_toxicity(docs, model, out_col="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_hypergeometric_shards")
def op8(spark, folder):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_link_trust_urls")
def op9(spark, folder):
    return judge_urls(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query("op10_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d""")
def op10(spark, folder):
    return exact_dedup(table(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


FILTER_AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
told AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, good, toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN told ON told.doc_id = w.doc_id),
cells AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told_steps AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((bits & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((bits & bit) > 0 AND (bits & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((bits & bit) > 0 AND (bits & before) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((bits & bit) > 0 AND (bits & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((bits & bit) > 0 AND (bits & before) = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told_steps"""


@query("op11_filter_postings", FILTER_AUDIT_SQL)
def op11(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit_filters(table(spark, folder, "documents"), corpus_filters(), labels)


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
freq AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT n) AS documents
  FROM (SELECT n, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c) AS c FROM freq GROUP BY ALL HAVING sum(documents) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(f.c, 0) AS c, k.c AS lang_c FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN freq f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sizes AS (SELECT lang, source, sum(c) AS n FROM grid GROUP BY ALL),
shares AS (SELECT g.lang, g.source, g.term, g.c, 1 + (1000000000::HUGEINT * (g.c + 1)) // (s.n + l.v) AS p,
    1 + (1000000000::HUGEINT * (g.lang_c + 1)) // (l.n + l.v) AS q
  FROM grid g JOIN sizes s ON s.lang = g.lang AND s.source = g.source JOIN langs l ON l.lang = g.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own)
QUALIFY part = 'pair' OR rank <= 200"""


@query("op12_term_runs", DIVERGENCE_SQL)
def op12(spark, folder):
    return audit_divergence(table(spark, folder, "documents"))


def word_tokenizer() -> dict:
    """File of the public vocabulary of words, whose tokens end with white space, a letter or a mark."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("word_bpe_49k.json"), "by_words": True}


#: Token id that ends a document in the files of op13.
FILE_END_ID = 2


@query("op13_token_files")
def op13(spark, folder):
    location = new_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), location, word_tokenizer(), FILE_END_ID)
    return read_token_files(spark, location).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
