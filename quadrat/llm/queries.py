"""One query per operator with production parameters, over whole tables, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.llm import byte_bpe, embedding_dedup, fill_in_middle, fingerprints, language_id, mixing, ngram_join, sentencepiece_sampling, source_audit, substring_dedup
from quadrat.llm import token_counts, token_files, url_filters
from quadrat.llm.shared import table
from quadrat.session import scratch_path

TOKEN_LIMIT = 4096
END_ID = 2


def op1_mixing(spark, sf):
    return mixing.taken_words(mixing.mix(table(spark, sf, "documents")))


def op2_embedding_dedup(spark, sf):
    return embedding_dedup.embedding_dedup(table(spark, sf, "embeddings"))


def op3_token_counts(spark, sf):
    path = scratch_path(spark, "prefixes")
    token_counts.token_counts(table(spark, sf, "documents"), TOKEN_LIMIT).write.option("compression", "zstd").parquet(path)
    found = token_counts.from_prefixes(spark.read.parquet(path), TOKEN_LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op4_fingerprints(spark, sf):
    return fingerprints.fingerprints(table(spark, sf, "documents"))


def op5_substring_dedup(spark, sf):
    return substring_dedup.find_repeats(table(spark, sf, "documents"), whole_lines=True)


def op6_language_id(spark, sf):
    return language_id.language_id(table(spark, sf, "documents"))


def op7_url_filters(spark, sf):
    return url_filters.url_verdicts(table(spark, sf, "pages"))


def op8_sentencepiece(spark, sf):
    encoded = sentencepiece_sampling.sample_pieces(table(spark, sf, "documents"))
    decoded = sentencepiece_sampling.decode_pieces(encoded)
    return decoded.select("doc_id", "n_chars", "n_pieces", "ids", (F.xxhash64("text") == F.col("text_hash")).alias("lossless"))


def op9_ngram_join(spark, sf):
    return ngram_join.ngram_join(table(spark, sf, "documents"), 3, 90)


def op10_token_files(spark, sf):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), path, END_ID)
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_byte_bpe(spark, sf):
    encoded = byte_bpe.encode(table(spark, sf, "documents"))
    decoded = byte_bpe.decode(encoded)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_source_audit(spark, sf):
    return source_audit.source_audit(table(spark, sf, "documents"))


def op13_fill_in_middle(spark, sf):
    found = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_embedding_dedup, op3_token_counts, op4_fingerprints, op5_substring_dedup, op6_language_id, op7_url_filters, op8_sentencepiece,
    op9_ngram_join, op10_token_files, op11_byte_bpe, op12_source_audit, op13_fill_in_middle,
)}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

COMPONENTS = """
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
"""

ORACLE = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE vecs AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), nodes AS (SELECT vec_id AS id FROM embeddings
), links AS (
  SELECT p.id AS a, q.id AS b FROM vecs p JOIN vecs q ON p.label = q.label AND p.id <> q.id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), {COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, min(r.b) AS component_id, min(r.b) = n.id AS kept
FROM nodes n JOIN reach r ON r.a = n.id GROUP BY n.id
""",
    "op7_url_filters": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), named AS (
  SELECT page_id, translate(raw, {LETTERS}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM named JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT n.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named n LEFT JOIN fits f ON f.page_id = n.page_id
""",
    "op9_ngram_join": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM worded
), nodes AS (SELECT id, len(s) AS n FROM sets
), shingles AS (SELECT id, unnest(s) AS x FROM sets
), met AS (
  SELECT p.id AS a, q.id AS b, count(*) AS common FROM shingles p JOIN shingles q ON p.x = q.x AND p.id <> q.id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * common >= 90 * (p.n + q.n - common)
), {COMPONENTS}
SELECT n.id AS doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM nodes n JOIN reach r ON r.a = n.id GROUP BY n.id, n.n
""",
    "op12_source_audit": f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), words AS (SELECT d, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, v
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS BIGINT) AS q FROM shares
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), found AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM whole WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_fill_in_middle": """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS i, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90
      THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m,
    array_to_string(u[greatest(i, j) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
}
