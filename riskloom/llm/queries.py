"""The registered queries of this subpackage over the given tables, with SQL where SQL can express the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import bpe, divergence, html, mixing, pseudonyms, records, repetition, revisits, secrets, setsketch, topk, toxicity, trie
from riskloom.llm.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Two-word shingles, similarity 0.8 or more, over all documents."""
    return setsketch.near_duplicates(_table(spark, folder, "documents"), length=2, percent=80)


QUERIES["op3_near_duplicates"] = op3_near_duplicates

# All pairs of documents that share a shingle, then the smallest doc_id by repeated propagation along links.
ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words ELSE [words[i], words[i + 1]] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.doc_id = l.a),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


def op7_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, the coverage they come with, and the verdict on every document."""
    return repetition.judged(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("covered_words_8").alias("n_repeat_words"), "base_failed", "kept",
        "dup_line_chars", "covered_chars_5", "covered_chars_8", "covered_chars_12")


QUERIES["op7_repetition"] = op7_repetition

ORACLES["op7_repetition"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (
  SELECT doc_id, n, i, words[i : i + n - 1] AS gram FROM p, (VALUES (5), (8), (12)) AS lengths(n) WHERE i + n - 1 <= len(words)),
twice AS (SELECT doc_id, n, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM twice),
covered AS (
  SELECT doc_id, count(*) FILTER (n = 8) AS n_repeat_words,
    coalesce(sum(len(words[i])) FILTER (n = 5), 0) AS c5, coalesce(sum(len(words[i])) FILTER (n = 8), 0) AS c8, coalesce(sum(len(words[i])) FILTER (n = 12), 0) AS c12
  FROM inside JOIN p USING (doc_id, i) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
by_line AS (
  SELECT doc_id, sum(times) AS n_lines, sum(times - 1) AS n_dup_lines, sum(times * len(line)) AS line_chars,
    coalesce(sum(times * len(line)) FILTER (times > 1), 0) AS dup_line_chars
  FROM lines GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(words) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(c5, 0) AS c5, coalesce(c8, 0) AS c8, coalesce(c12, 0) AS c12
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * c5 > 40 * word_chars OR 100 * c8 > 30 * word_chars OR 100 * c12 > 25 * word_chars
       OR 100 * dup_line_chars > 40 * line_chars OR 100 * n_dup_lines > 50 * n_lines) AS kept,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, CAST(c5 AS BIGINT) AS covered_chars_5, CAST(c8 AS BIGINT) AS covered_chars_8, CAST(c12 AS BIGINT) AS covered_chars_12
FROM counts"""


def op10_bpe(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document; `tokenizer` is the path of the vocabulary file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(_table(spark, folder, "documents"), tokenizer, digests=True)


QUERIES["op10_bpe"] = op10_bpe


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Weights 5, 2, 1 over all sources, 150 % of all words, no source above twice its words."""
    return mixing.mix_sources(_table(spark, folder, "documents"), percent=150, most=2, weights=(5, 2, 1)).select(
        "doc_id", "size", "source_size", "target", "taken")


QUERIES["op4_mixing"] = op4_mixing

# The level is the first, in order of cap by weight, that leaves the next source below its cap; documents in order of hash.
ORACLES["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
r AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM t),
o AS (
  SELECT source, s, w, 2.0::DOUBLE * s / w AS cap,
    CAST(coalesce(sum(2 * s) OVER before, 0) AS DOUBLE) AS fixed, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS free,
    CAST(sum(s) OVER () AS DOUBLE) * 150 / 100 AS budget
  FROM r WINDOW before AS (ORDER BY 2.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((budget - fixed) / free, cap) AS level FROM o WHERE (budget - fixed) / free <= cap),
targets AS (SELECT source, s, least(level * w, CAST(2 * s AS DOUBLE)) AS target FROM o, level),
plan AS (SELECT source, s, target, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole FROM targets),
c AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h) AS DOUBLE) AS cum, CAST(sum(size) OVER (PARTITION BY source, h) AS DOUBLE) AS tie
  FROM d)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (whole + CAST(cum <= target - whole * s
    OR (cum - tie <= target - whole * s AND 2 * (target - whole * s - (cum - tie)) >= tie) AS INTEGER)) AS BIGINT) AS taken
FROM c JOIN plan ON c.source IS NOT DISTINCT FROM plan.source"""


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, a digest of the base spans and all spans of every document."""
    found = secrets.scan(_table(spark, folder, "documents"), keep=["doc_id"])
    base = list(secrets.KINDS)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined([*base, secrets.ADDED]).alias("spans"))


QUERIES["op9_secrets"] = op9_secrets


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model learnt from the labelled rows that are not held out."""
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "exact", "misspelt")


QUERIES["op5_toxicity"] = op5_toxicity


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector against all others, 20 best each."""
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES["op1_top_k"] = op1_top_k

ORACLES["op1_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES["op2_html"] = op2_html


def op8_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit of an archive made of all pages, with the response it stands for and the merged headers."""
    found = revisits.resolve(revisits.archive_records(_table(spark, folder, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select("record_id", F.col("key").alias("url"), F.col("at").alias("visited_at"), F.coalesce("target_id", F.lit(-1)).alias("target_id"), "state", F.array_join(listed, "|").alias("headers"), "digest")


QUERIES["op8_revisits"] = op8_revisits

ORACLES["op8_revisits"] = r"""
WITH p AS (
  SELECT page_id, url, html, md5(coalesce(html, '')) AS tag, 1700000000 + page_id * 60 AS first,
    CASE WHEN page_id % 2 = 0 THEN CAST(1700000000 + page_id * 60 - 86400 AS VARCHAR) END AS day,
    regexp_replace(url, '#.*$', '') AS bare FROM pages),
u AS (
  SELECT *, CASE WHEN contains(bare, '?') THEN split_part(bare, '?', 1) || '?' || array_to_string(list_sort(string_split(split_part(bare, '?', 2), '&')), '&') ELSE bare END AS key FROM p),
responses AS (
  SELECT page_id * 8 AS target_id, key, first AS ts, tag AS etag, day, tag, len(html) AS size FROM u
  UNION ALL SELECT page_id * 8 + 4, key, first + 86400, '2' || tag, day, tag, len(html) FROM u WHERE page_id % 3 = 0),
visits AS (
  SELECT page_id * 8 + 1 AS record_id, key, first + 3600 * (1 + page_id % 40) AS ts, tag AS etag, NULL AS day, page_id % 7 AS age, 1 AS n FROM u
  UNION ALL SELECT page_id * 8 + 2, key, first + 7200, NULL, day, NULL, 2 FROM u
  UNION ALL SELECT page_id * 8 + 3, key, first - 3600, tag, NULL, page_id % 7, 3 FROM u),
m AS (
  SELECT v.*, r.target_id, r.etag AS stored_etag, r.day AS stored_day, r.tag, r.size FROM visits v LEFT JOIN responses r ON r.key = v.key AND r.ts < v.ts
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.target_id DESC) = 1),
s AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'missing' WHEN coalesce(etag = stored_etag, day = stored_day) IS NULL THEN 'unverified'
    WHEN coalesce(etag = stored_etag, day = stored_day) THEN 'resolved' ELSE 'conflict' END AS state FROM m)
SELECT record_id, key AS url, ts AS visited_at, coalesce(target_id, -1) AS target_id, state,
  CASE WHEN state IN ('resolved', 'unverified') THEN array_to_string(list_sort(list_filter([
    'cache-control: max-age=' || CASE WHEN n = 2 THEN '60' ELSE CAST(age AS VARCHAR) END, 'content-length: ' || size, 'content-type: text/html',
    'etag: ' || CASE WHEN n = 2 THEN '' ELSE 'W/' END || '"' || CASE WHEN n = 2 THEN stored_etag ELSE etag END || '"',
    'last-modified: ' || CASE WHEN n = 2 THEN coalesce(day, stored_day) ELSE stored_day END, CASE WHEN n = 2 THEN 'vary: Accept' END],
    lambda x: x IS NOT NULL)), '|') END AS headers,
  CASE WHEN state IN ('resolved', 'unverified') THEN tag END AS digest
FROM s"""


def op6_pseudonyms(spark: SparkSession, folder: str, key: str = "a key that a deployment keeps secret") -> DataFrame:
    """All documents with their personal data pseudonymised, and how many values of each kind they had."""
    out = pseudonyms.pseudonymise(_table(spark, folder, "documents").select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *map(count, pseudonyms.KINDS))


QUERIES["op6_pseudonyms"] = op6_pseudonyms


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES["op12_prefix_trie"] = op12_prefix_trie

# The checksum of the decimal id is taken bit by bit; prefixes are compared as whole lists of (role, text).
ORACLES["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY r) AS turns,
    xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY conv_id),
seqs AS (SELECT c.conv_id, coalesce(d.turns[1 : c.h], []) || c.turns[c.h + 1 :] AS s FROM c LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, s, d, s[1 : d] AS node FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
n AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(s)), '')) AS ends_sha256
  FROM p GROUP BY node, d),
k AS (SELECT node[1 : depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
up AS (SELECT m.node[1 : a] AS node, a AS depth, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) m),
sub AS (SELECT node, depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY node, depth)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, sub.n_leaves,
  CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN sub USING (node, depth) LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.node = m.node[1 : m.depth - 1]"""


def op13_records(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as token records in ascending order of id, written and read back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    target = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    records.write_texts(records.in_order(_table(spark, folder, "documents")), target, tokenizer, end=2)
    found = records.read_records(spark, target)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES["op13_records"] = op13_records


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """All sources of all languages against each other and, term by term, against their language."""
    return divergence.divergence(_table(spark, folder, "documents"), least=3, best=200)


QUERIES["op11_divergence"] = op11_divergence

ORACLES["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM (SELECT i, lang, source, unnest(terms) AS term FROM d) GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (
  SELECT g.lang, g.source, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(t.n) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source) m USING (lang, source)),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(t.n, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(t.n, 0) + 1)) // (s.n + v.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS BIGINT) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN t ON t.lang = s.lang AND t.source = s.source AND t.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200"""
