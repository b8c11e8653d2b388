"""The operators applied to their whole tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.chat import chat_digest, format_chats
from kinetable.llm.decontaminate import contaminated
from kinetable.llm.exact import exact_duplicates
from kinetable.llm.html import extract_pages
from kinetable.llm.minhash import near_duplicates
from kinetable.llm.packing import pack
from kinetable.llm.spelling import spelling_variants
from kinetable.llm.substring import repeated_passages
from kinetable.llm.tokens import token_counts
from kinetable.llm.toxicity import score_toxicity
from kinetable.llm.trie import prefix_trie, rebuilt_turns
from kinetable.llm.urls import judge, rule_table
from kinetable.llm.wavelet import read_tokens, write_token_shards
from kinetable.session import scratch_path

# The rules of the query, as verdict, host and start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ODD_TEXT = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(_table(spark, root, "documents"))


def op2_chat_format(spark: SparkSession, root: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ODD_TEXT).alias("text"))
    turns = _table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat_digest(format_chats(turns))


def op3_html_extract(spark: SparkSession, root: str) -> DataFrame:
    return extract_pages(_table(spark, root, "pages"))


def op4_best_fit_pack(spark: SparkSession, root: str) -> DataFrame:
    return pack(_table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_duplicates(_table(spark, root, "documents"))


def op6_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts(_table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return judge(_table(spark, root, "pages"), rule_table(spark, URL_RULES))


def op8_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return score_toxicity(_table(spark, root, "documents"), _table(spark, root, "labels"))


def op9_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return repeated_passages(_table(spark, root, "documents"))


def op10_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return contaminated(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def op11_token_shards(spark: SparkSession, root: str) -> DataFrame:
    manifest = write_token_shards(_table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-shards"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling_variants(_table(spark, root, "documents"), typo_every=199)


def op13_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(_table(spark, root, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_chat_format, op3_html_extract, op4_best_fit_pack, op5_exact_dedup,
        op6_token_counts, op7_url_filter, op8_toxicity, op9_substring_dedup, op10_decontaminate,
        op11_token_shards, op12_spelling_variants, op13_prefix_trie)
}

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

# The unsigned crc32 of a text column ``s`` in SQL: the table of a byte from its rule, then a fold over the bytes.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS steps)"""


def _crc32(text: str) -> str:
    data = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_transform(range(length({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::BIGINT), "
            "lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295), 4294967295)")


ORACLES = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) m USING (doc_id)""",
    "op2_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, '<turn ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>'
  || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</turn>' || chr(10) AS seg FROM t),
p AS (SELECT *, ceil(strlen(seg) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, seg) - 1 AS pos FROM x),
y AS (SELECT conv_id, min(pos) AS sys_pos, arg_min(cost, pos) AS sys_cost, arg_min(length(seg), pos) AS sys_len FROM p WHERE role = 'system' GROUP BY conv_id),
q AS (SELECT p.*, y.sys_pos, coalesce(y.sys_len, 0) AS sys_len, greatest(1, 768 - coalesce(sys_cost, 0)) AS room, coalesce(pos = sys_pos, false) AS is_system,
  sum(cost) OVER (PARTITION BY p.conv_id ORDER BY pos) - cost - CASE WHEN pos > sys_pos THEN sys_cost ELSE 0 END AS before FROM p LEFT JOIN y USING (conv_id)),
v AS (SELECT *, CASE WHEN NOT is_system THEN 2 * (before // room) + CASE WHEN before + cost > (before // room + 1) * room THEN 1 ELSE 0 END END AS win FROM q),
h AS (SELECT *, lead(win, 1) OVER o AS w1, lead(win, 2) OVER o AS w2, lead(before, 1) OVER o AS b1, lead(before, 2) OVER o AS b2 FROM v WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
again AS (SELECT *, CASE WHEN w1 IS NOT NULL AND w1 <> win AND b1 - before <= 256 THEN 1 ELSE 0 END
  + CASE WHEN w2 IS NOT NULL AND (w1 IS NULL OR w2 <> w1) AND w2 <> win AND b2 - before <= 256 THEN 1 ELSE 0 END AS copies FROM h),
f AS (SELECT conv_id, sum(CASE WHEN is_system THEN 0 ELSE length(seg) * (1 + copies) END) + max(sys_len) * greatest(1, count(DISTINCT win)) AS formatted_chars FROM again GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(f.formatted_chars)::BIGINT AS formatted_chars
FROM t JOIN f USING (conv_id) GROUP BY t.conv_id""",
    "op3_html_extract": r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM b),
d AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM c)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM d""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
    "op7_url_filter": rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, verdict, rule_host, rule_path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (SELECT s.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM s
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE crc AS {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r GROUP BY ALL),
h AS (SELECT run, times, {_crc32("s")} AS h FROM d, crc),
m AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, unnest(range(length(word))) AS place FROM v),
less AS (SELECT word, n, place, left(word, place::INT) || substr(word, place::INT + 2) AS rest FROM cut),
p AS (SELECT a.word, b.word AS near FROM less a JOIN less b USING (place, rest) WHERE a.word <> b.word
  UNION SELECT a.word, v.word FROM less a JOIN v ON v.word = a.rest UNION SELECT v.word, a.word FROM less a JOIN v ON v.word = a.rest),
k AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY b.n DESC, p.near) AS best, max(b.n) AS best_n FROM p JOIN v b ON b.word = p.near GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN k USING (word)),
w AS (SELECT word, word AS last, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.next)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.next IS NULL""",
    "op13_prefix_trie": rf"""
WITH crc AS {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
c AS (SELECT conv_id, {_crc32("s")} % 9 AS h FROM i, crc),
b AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos < h
  UNION ALL SELECT t.conv_id, h + pos, role, text FROM t JOIN c USING (conv_id) WHERE pos >= h),
r AS (SELECT conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path FROM c LEFT JOIN b USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, len(path) AS size, d AS depth, path[1:d] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM r)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(prefix[depth].text), 0) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM p GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
u AS (SELECT d AS depth, prefix[1:d] AS prefix, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM e)),
s AS (SELECT depth, prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY ALL)
SELECT e.conv_id, e.depth, a.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM e JOIN s USING (depth, prefix) LEFT JOIN n a ON a.depth = e.depth - 1 AND a.prefix = e.prefix[1:e.depth - 1]""",
}
