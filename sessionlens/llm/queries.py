"""The training-data operators as queries over the test tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, filter_audit, html_text, licenses, mixing, packing, prefix_trie, quality, secrets, set_join, simhash, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a thousand ids a directory, a hundred and ten of them in those below.

    Every second text that speaks of a license is a licence file: of its hundred, or each fourth one of its thousand.
    """
    id_ = F.col("doc_id")
    say = lambda n: F.floor(n).cast("string")
    thousand = F.concat(F.lit("corpus/"), say(id_ / 1000))
    hundred = F.concat(thousand, F.lit("/"), say(id_ / 100))
    holds = F.coalesce(F.col("text").contains("icense"), F.lit(False)) & (id_ % 2 == 0)
    file = F.concat(F.when(id_ % 4 == 0, thousand).otherwise(hundred), F.lit("/LICENSE-"), say(id_))
    return docs.select("doc_id", F.when(holds, file).otherwise(F.concat(hundred, F.lit("/"), say(id_ / 10), F.lit("/"), say(id_), F.lit(".txt"))).alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence files speak for the directories below theirs; `document_files` gives the paths."""
    return licenses.scan_licenses(document_files(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: where the schedule first takes the document, and in how many slots."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).documents.drop("copies", "text_hash")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.shingle_join(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_licenses, op3_simhash, op4_exact_dedup, op5_quality, op6_packing, op7_secrets, op8_nearest, op9_mixing, op10_html, op11_set_join, op12_prefix_trie, op13_filter_audit)
}


def license_sql() -> str:
    rows, idf, unseen = licenses.template_vectors(licenses.TEMPLATES)
    vectors = ", ".join(f"('{k}', {i}, '{t}', {w!r}::double)" for k, i, t, w in rows)
    known = ", ".join(f"('{t}', {w!r}::double)" for t, w in idf.items())
    return f"""
WITH vectors(license, nth, term, weight) AS (VALUES {vectors}), known(term, idf) AS (VALUES {known}),
files AS (SELECT doc_id, text, 'corpus/' || (doc_id // 1000)::varchar AS up, up || '/' || (doc_id // 100)::varchar AS here,
  CASE WHEN coalesce(contains(text, 'icense'), false) AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN up ELSE here END || '/LICENSE-' || doc_id::varchar
  ELSE here || '/' || (doc_id // 10)::varchar || '/' || doc_id::varchar || '.txt' END AS path, regexp_replace(path, '/[^/]*$', '') AS dir FROM documents),
parts AS (SELECT DISTINCT path, unnest(string_split(text, chr(10)) || string_split_regex(text, '{licenses.BLOCK_END}') || [text]) AS value FROM files),
terms AS (SELECT path, value, unnest(regexp_extract_all(lower(value), '{licenses.TERM}')) AS term FROM parts),
weighed AS (SELECT path, value, term, (1 + ln(count(*))) * coalesce(any_value(idf), {unseen!r}) AS w FROM terms LEFT JOIN known USING (term) GROUP BY path, value, term),
norms AS (SELECT path, value, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY path, value),
cosine AS (SELECT path, license, round(sum(w * weight) / any_value(norm), 6) AS score FROM weighed JOIN vectors USING (term) JOIN norms USING (path, value) GROUP BY path, value, license, nth),
own AS (SELECT path, license, score FROM cosine WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
holders AS (SELECT dir, license, score FROM own JOIN files USING (path) WHERE path LIKE '%/LICENSE-%' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
near AS (SELECT f.dir, h.dir AS above, h.license, h.score FROM (SELECT DISTINCT dir FROM files) f JOIN holders h ON starts_with(f.dir || '/', h.dir || '/') QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY length(h.dir) DESC) = 1)
SELECT path, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
  CASE WHEN own.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own.license IS NULL THEN above END AS from_dir
FROM files LEFT JOIN own USING (path) LEFT JOIN near USING (dir)"""


ORACLE_SQL: dict[str, str] = {
    "op2_licenses": license_sql(),
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_set_join": """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS shingles FROM words),
texts AS (SELECT min(doc_id) AS node, max(len(shingles)) AS n, any_value(shingles) AS shingles, list(doc_id) AS ids FROM sets GROUP BY list_sort(shingles)),
terms AS (SELECT node, n, unnest(shingles) AS term FROM texts),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n + b.n) AS sizes FROM terms a JOIN terms b ON a.term = b.term AND a.node <> b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (sizes - common)),
reach(node, other) AS (SELECT node, node FROM texts UNION SELECT node, b FROM reach JOIN links ON other = a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
members AS (SELECT node, unnest(ids) AS doc_id FROM texts WHERE n > 0)
SELECT doc_id, len(shingles) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN members USING (doc_id) LEFT JOIN least USING (node)""",
    "op12_prefix_trie": """
WITH ids AS (SELECT conv_id, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::ubigint ELSE 0::ubigint END))), 4294967295::ubigint) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT conv_id, coalesce(first.turns, [])[1:h] || own.turns[h + 1:] AS turns FROM ids JOIN own USING (conv_id) LEFT JOIN own first ON first.conv_id = ids.conv_id - ids.conv_id % 100),
steps AS (SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns[1:depth] AS path FROM built),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, depth > 0 AS below, coalesce(length(path[depth].text), 0) AS points,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM steps GROUP BY path, depth),
parents AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.below AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE below GROUP BY 1),
leaves AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (path)),
sums AS (SELECT above AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * points)::bigint AS saved_tokens FROM (SELECT n_children, n_convs, points, unnest(list_transform(range(depth + 1), lambda d: path[1:d])) AS above FROM leaves) GROUP BY above)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM leaves JOIN sums USING (path)""",
    "op13_filter_audit": """
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
masks AS (SELECT part, doc_id, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::int AS mask FROM words),
known AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step::int AS step, 1 << (ascii(filter_order[step]) - 65) AS bit, coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)), 0)::int AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counts AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::bigint AS toxic_lost,
    sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::bigint AS shapley FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM counts""",
}
