"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm import bpe, conversation_trie, decontaminate, fm_quality, html_text, near_dup, ngram_lm, quality_rules, secrets, sharding, spelling, suffix_dedup, token_orc
from crosspanel.llm.common import table, texts


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(texts(spark, sf_dir, "documents"), size=4, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.train_and_classify(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(texts(spark, sf_dir, "documents"), keep_text=False)


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(texts(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(texts(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(texts(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(texts(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(texts(spark, sf_dir, "documents"), shards=24)


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_near_dup, op3_quality_rules, op4_fm_quality, op5_suffix_dedup, op6_ngram_lm, op7_html_text, op8_decontaminate, op9_bpe, op10_secrets, op11_spelling_variants, op12_conversation_trie, op13_sharding)}


def crc32_sql(codes: str) -> str:
    """CRC-32 in DuckDB of a list of code points below U+0100, as UTF-8."""
    octets = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 192 THEN [194, c] ELSE [195, c - 64] END))"
    shifted = "list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, {})"
    return f"xor(list_reduce({octets}, lambda r, o: {shifted.format('xor(r, o::BIGINT)')}, 4294967295::BIGINT), 4294967295)"


OP11_SQL = f"""
WITH runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
summed AS (SELECT run, {crc32_sql("list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x))")} AS h FROM runs),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
linked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE walk(word, here) AS (SELECT word, word FROM linked UNION ALL SELECT walk.word, l.form FROM walk JOIN linked l ON walk.here = l.word WHERE l.form IS NOT NULL)
  SELECT walk.word, here AS root FROM walk JOIN linked l ON walk.here = l.word WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN chain USING (word)
"""

OP12_SQL = f"""
WITH own AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x))")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
made AS (SELECT c.conv_id, 0 AS part, i, digest, words FROM convs c JOIN own o ON o.conv_id = c.conv_id - ((c.conv_id % 20) + 20) % 20 AND i <= h
  UNION ALL SELECT conv_id, 1, i, digest, words FROM convs JOIN own USING (conv_id) WHERE i > h),
paths AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, words FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
stood AS (SELECT conv_id, depth, path, words FROM paths UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, CASE WHEN min(depth) > 0 THEN left(path, 32 * (min(depth) - 1)::INT) END AS parent FROM stood GROUP BY path),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT left(path, 32 * k::INT) AS path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM nodes LEFT JOIN children USING (path), unnest(range(depth + 1)) AS u(k) GROUP BY 1),
last AS (SELECT conv_id, max(path ORDER BY depth) AS path FROM stood GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.path LEFT JOIN children c ON n.path = c.path JOIN below b ON n.path = b.path LEFT JOIN ends e ON n.path = e.path
"""

#: Words of `documents` are those between ASCII blanks, in lower case from A to Z; a table of shingles by document, then links by the sizes of intersections.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s FROM w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS u(i)),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reached(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""
#: Strings of 50 bytes as digests of their hex, each with the smallest document that has it; what they cover, and what is left, piece by piece.
OP5_SQL = """
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, 400 * p AS o, substr(h, 800 * p + 1, 898) AS c FROM t, unnest(range((n + 399) // 400)) AS u(p)),
w AS (SELECT doc_id, o + i AS i, md5_number(substr(c, 2 * i + 1, 100)) AS s FROM c, unnest(range(greatest(least(400, length(c) // 2 - 49), 0))) AS u(i)),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
bad AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE doc_id > least),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM bad)) GROUP BY doc_id, k),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM runs GROUP BY 1),
kept AS (SELECT t.doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda k: h[2 * (CASE WHEN k = 0 THEN 0 ELSE z[k] END) + 1 : 2 * (CASE WHEN k = len(a) THEN n ELSE a[k + 1] END)]), '') END AS h FROM t LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""
#: Windows of ten words (or a shorter item's own) as texts, met by the windows of as many words of the documents.
OP8_SQL = r"""
WITH low AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS BIGINT) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sought AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS s FROM item, unnest(range(greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0),
had AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM low, (SELECT DISTINCT n FROM sought) k, unnest(range(greatest(len(w) - n + 1, 0))) AS u(i)),
met AS (SELECT doc_id, i, n, item_id FROM had JOIN sought USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM met, unnest(range(n)) AS u(j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_near_dup": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_conversation_trie": OP12_SQL}
