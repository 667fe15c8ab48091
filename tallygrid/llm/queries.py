"""The registered queries of the corpus operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import bpe_tree, chat, decontaminate, line_dedup, maxent_lm, pii, quality, ranked_search, sharding, simhash_golay, source_audit, token_files, url_filter
from tallygrid.llm.common import read

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: The conversation that op4 adds, which says the template's own control strings.
CONTROL_TALK = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, equal texts together where the quotas let them."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("same"))
    got = sharding.shard_rows(docs, F.col("same"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the output."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_TALK, "conv_id long, turn long, role string, text string"))
    got = chat.read_back(chat.format_trees(chat.chain(rows)))
    return got.select(F.expr("try_cast(tree AS bigint)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(0)) == 0
    trained = maxent_lm.train(docs.where(~out_of).select("text"))
    got = maxent_lm.score(docs, trained)
    return got.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by tree reduction."""
    return bpe_tree.encode_documents(read(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    got = simhash_golay.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality.verdicts(read(spark, sf_dir, "documents"))


#: The key of op8's pseudonyms. A deployment passes its own, secret one to ``pii.pseudonymize``.
PSEUDONYM_KEY = "tallygrid-example-key"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    got = pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return got.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files in order of doc_id and read back."""
    files = token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read(files)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    got = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"))


#: The rules by which op11 judges pages.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict, aliases by canonical links, refreshes and stand-in hosts included."""
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of a language diverges from the others, and its marks."""
    return source_audit.audit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP4 = r"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\]|TURN |/TURN\])', '\1\\\2\3', 'g')) AS n FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 5 ELSE n + 16 + length(replace(replace(role, '%', '%25'), ']', '%5D')) END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT coalesce(source, '') AS host, md5(text) AS page, unnest(list_distinct(list_filter(ls, lambda x: trim(x) <> ''))) AS l FROM d),
t AS (SELECT coalesce(source, '') AS host, count(DISTINCT md5(text)) AS total FROM d GROUP BY 1),
n AS (SELECT host, l, count(DISTINCT page) AS pages, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 50 AS long FROM e GROUP BY host, l),
b AS (SELECT host, list(l) AS cut FROM n JOIN t USING (host) WHERE CASE WHEN long THEN pages >= 2 AND pages > 0.0002::DOUBLE * total ELSE pages >= 3 AND pages > 0.01::DOUBLE * total END GROUP BY host),
k AS (SELECT doc_id, source, ls, text, list_filter(ls, lambda x: NOT list_contains(coalesce(cut, []::VARCHAR[]), x)) AS kept FROM d LEFT JOIN b ON coalesce(d.source, '') = b.host)
SELECT doc_id, source, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256, length(coalesce(array_to_string(kept, chr(10)), ''))::BIGINT AS chars_left FROM k
"""

_OP6 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(greatest(len(ws) - 12, 1)), lambda i: array_to_string(list_slice(ws, i + 1, i + 13), ' '))) AS win FROM iw WHERE len(ws) > 0),
gram AS (SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS i, unnest(list_transform(range(len(ws) - n + 1), lambda i: array_to_string(list_slice(ws, i + 1, i + n), ' '))) AS win FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM gram JOIN win USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP7 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(len(ws) - 2), lambda i: array_to_string(list_slice(ws, i + 1, i + 3), ' '))) AS gram FROM w WHERE len(ws) > 2),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS uppers, length(text) - length(replace(text, '!', '')) AS bangs FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR 2 * letters < word_chars OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words
    OR 4 * bangs > n_words OR 2 * uppers > word_chars OR 10 * n_dup_lines > 5 * n_lines) AS kept FROM m
"""


_OP11 = r"""
WITH RECURSIVE rules(says, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
g AS (SELECT r, url, rest, unnest(regexp_extract_all(html, '<!--.*?-->|<script\b.*?</script>|<(?:link|meta)\b[^>]*>', 0, 'is')) AS t FROM u WHERE contains(url, '://')),
l AS (SELECT *, CASE WHEN regexp_matches(t, '^<link\b.*\brel\s*=\s*["'']?canonical\b', 'is') THEN trim(regexp_extract(t, '\shref\s*=\s*["'']?([^"''>\s]*)', 1, 'i'), ' ')
  WHEN regexp_matches(t, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is') THEN trim(regexp_extract(t, '\burl\s*=\s*["'']?([^"''>]+)', 1, 'i'), ' ') END AS to_ FROM g),
ends AS (
  SELECT url AS a, CASE WHEN contains(to_, '://') THEN to_ WHEN to_ LIKE '//%' THEN 'http:' || to_ ELSE 'http://' || regexp_extract(rest, '^[^/?#]*') || CASE WHEN to_ LIKE '/%' THEN to_ ELSE regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', '') || to_ END END AS b
  FROM l WHERE to_ <> '' AND to_ NOT LIKE '#%'
  UNION ALL SELECT url, 'http://' || regexp_extract(lower(rest), '^(?:www|m)\.([^/]*\.[^/?#]*)', 1) || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) FROM u WHERE regexp_matches(lower(rest), '^(?:www|m)\.[^/?#]*\.')),
every AS (SELECT DISTINCT url, replace(substr(url, strpos(url, '://') + 3), '&amp;', '&') AS rest FROM (SELECT url FROM u UNION ALL SELECT a FROM ends UNION ALL SELECT b FROM ends) WHERE contains(url, '://')),
parts AS (SELECT url, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^.*@', ''), '\.?(:(80|443)?)?$', '') AS h,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=.*)?$')) AS q FROM every),
named AS (SELECT url, h, CASE p WHEN '' THEN '/' ELSE p END AS p, h || CASE p WHEN '' THEN '/' ELSE p END || CASE WHEN array_to_string(q, '&') = '' THEN '' ELSE '?' || array_to_string(q, '&') END AS node FROM parts WHERE h <> ''),
node AS (SELECT n.node, arg_max(says, length(r.h || r.p)) AS says FROM (SELECT DISTINCT node, regexp_replace(h, ':\d+$', '') AS h, p FROM named) n LEFT JOIN rules r ON (n.h = r.h OR ends_with(n.h, '.' || r.h)) AND starts_with(n.p, r.p) GROUP BY n.node),
edge AS (SELECT x.node AS a, y.node AS b FROM ends JOIN named x ON x.url = ends.a JOIN named y ON y.url = ends.b),
bad AS (SELECT node FROM node WHERE says = 'block' UNION SELECT e.b FROM bad JOIN (SELECT a, b FROM edge UNION SELECT b, a FROM edge) e ON e.a = bad.node),
place AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
own AS (SELECT x.r, arg_max(r.says, length(r.h || r.p)) AS says, arg_max(r.h || r.p, length(r.h || r.p)) AS rule FROM place x JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY x.r)
SELECT page_id, host, path, rule, coalesce(own.says, node.says, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN own.says IS NOT NULL THEN 'rule' WHEN node.says IS NOT NULL OR bad.node IS NOT NULL THEN 'alias' ELSE 'none' END AS "by"
FROM place LEFT JOIN own USING (r) LEFT JOIN named USING (url) LEFT JOIN node USING (node) LEFT JOIN bad USING (node)
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT item, item_id, t, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS item, item_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t),
s AS (SELECT item, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t), a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS tf FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(tf)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(*) >= 10),
c AS (SELECT lang, source, term, sum(tf)::HUGEINT AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (g.n + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (v.n + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_maxent_lm, op3_bpe_tree, op4_chat_trees, op5_simhash_golay, op6_decontaminate, op7_quality_cascade, op8_pii_pseudonyms, op9_token_files, op10_line_dedup, op11_url_filter, op12_ranked_search, op13_source_audit, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_trees": _OP4, "op6_decontaminate": _OP6, "op7_quality_cascade": _OP7, "op10_line_dedup": _OP10, "op11_url_filter": _OP11, "op12_ranked_search": _OP12, "op13_source_audit": _OP13}
