"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from gleanframe.llm.bpe import encode_documents
from gleanframe.llm.common import table
from gleanframe.llm.decontaminate import contamination
from gleanframe.llm.exact_dedup import exact_duplicates
from gleanframe.llm.language import identify
from gleanframe.llm.near_dedup import near_duplicates
from gleanframe.llm.pii import personal_data
from gleanframe.llm.quotes import reply_order
from gleanframe.llm.resample import resample
from gleanframe.llm.spelling import spelling_variants
from gleanframe.llm.suffix_dedup import remove_repeats
from gleanframe.llm.toxicity import toxicity
from gleanframe.llm.url_rules import judge
from gleanframe.llm.warc import round_trip

#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/")]


def op1_toxicity(spark, folder):
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_warc(spark, folder):
    return round_trip(table(spark, folder, "pages"))


def op3_exact_dedup(spark, folder):
    return exact_duplicates(table(spark, folder, "documents"))


def op4_url_filters(spark, folder):
    return judge(table(spark, folder, "pages"), RULES)


def op5_quotation_linking(spark, folder):
    return reply_order(table(spark, folder, "conversations"))


def op6_language(spark, folder):
    return identify(table(spark, folder, "documents"))


def op7_byte_bpe(spark, folder):
    import public_tokenizers

    return encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op8_decontaminate(spark, folder):
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_suffix_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))


def op10_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


def op11_spelling_variants(spark, folder):
    return spelling_variants(table(spark, folder, "documents"), noise=199)


def op12_personal_data(spark, folder):
    return personal_data(table(spark, folder, "documents"))


def op13_resample(spark, folder):
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


def queries():
    return {f.__name__: f for f in (
        op1_toxicity, op2_warc, op3_exact_dedup, op4_url_filters, op5_quotation_linking, op6_language, op7_byte_bpe, op8_decontaminate,
        op9_suffix_dedup, op10_near_dedup, op11_spelling_variants, op12_personal_data, op13_resample)}


OP2_SQL = """
WITH own AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
best AS (SELECT digest, max(page_id) AS first FROM own WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM own LEFT JOIN best USING (digest)
"""

LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^([^/?#]*)', 1), {LOWERED})"


def _rest(url: str) -> str:
    return f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    path = _path(url)
    done = f"""list_reduce(list_concat([''], string_split({path}, '/')[2:]),
      lambda done, part: CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)"""
    plain = f"""CASE WHEN {path} = '' THEN '/' WHEN NOT regexp_matches({path}, '/\\.\\.?(/|$)') THEN {path}
      WHEN {done} = '' THEN '/' ELSE {done} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END END"""
    return f"regexp_replace({_host(url)}, ':(80|443)?$', '') || {plain} || coalesce(regexp_extract({_rest(url)}, '^[^?#]*(\\?[^#]*)', 1), '')"


def _absolute(link: str, url: str) -> str:
    site, folder = f"'x://' || {_host(url)}", f"regexp_replace(CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END, '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link}
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN {link} LIKE '//%' THEN 'x:' || {link} WHEN {link} LIKE '/%' THEN {site} || {link} WHEN {link} LIKE '#%' THEN {url}
      WHEN {link} LIKE '?%' THEN {site} || {_path(url)} || {link} ELSE {site} || {folder} || {link} END"""


HREF_SQL, URL_SQL = ("'(?is)\\b%s\\s*=\\s*[\"'']?\\s*([^\"''\\s>]+)'" % k for k in ("href", "url"))
OP4_SQL = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), own AS (
  SELECT page_id, url, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node,
         regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)', ' ', 'g') AS html FROM pages
), named AS (
  SELECT *, replace(regexp_extract(regexp_extract(html, '(?is)<base\b[^>]*\bhref\b[^>]*>'), {HREF_SQL}, 1), '&amp;', '&') AS base FROM own WHERE host <> ''
), based AS (
  SELECT node, html, coalesce(CASE WHEN base <> '' THEN {_absolute('base', 'url')} END, url) AS base FROM named
), found AS (
  SELECT node, base, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, {HREF_SQL}, 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, {URL_SQL}, 1)))), '&amp;', '&') AS link
  FROM based
), resolved AS (SELECT node AS a, {_absolute('link', 'base')} AS target FROM found WHERE link <> ''
), edges AS (SELECT a, {_node('target')} AS b FROM resolved WHERE target IS NOT NULL AND {_host('target')} <> ''
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), ruled AS (
  SELECT node, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT a AS node, regexp_extract(a, '^([^/?#]*)', 1) AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM both_ways) n
  JOIN rules r ON (n.host = r.host OR suffix(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY node
), spread AS (SELECT DISTINCT a AS node FROM reach JOIN ruled ON reach.b = ruled.node WHERE verdict = 'block'
), best AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM own JOIN rules r ON (own.host = r.host OR suffix(own.host, '.' || r.host)) AND starts_with(own.path, r.path) GROUP BY page_id
)
SELECT own.page_id, coalesce(own.host, '') AS host, coalesce(own.path, '') AS path, best.rule,
       coalesce(best.verdict, CASE WHEN spread.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN best USING (page_id) LEFT JOIN spread ON spread.node = own.node AND own.host <> ''
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP8_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS words
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM lowered, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, p, size, item_id FROM places JOIN windows USING (size, words)),
words_hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY 1),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


#: CRC-32 of hexadecimal bytes: a table of 256 values, then a step a byte.
CRC_SQL = r"""
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), crcs AS (
  SELECT item, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(item)), lambda k: CAST('0x' || substr(hexed, 2 * k + 1, 2) AS BIGINT))),
                                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT item, hex(encode(item)) AS hexed FROM items), crc_table
)"""

OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT CAST(doc_id AS VARCHAR) AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), items AS (SELECT id || ':' || run AS item FROM runs), """ + CRC_SQL + r""", counted AS (
  SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, sum(n) AS n
  FROM runs JOIN crcs ON item = id || ':' || run GROUP BY 1
), words AS (SELECT word, CAST(n AS BIGINT) AS n FROM counted WHERE length(word) >= 6 AND n >= 5
), shorter AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b USING (p, rest) WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, min(other) FILTER (n = top) AS form
  FROM (SELECT near.word, other, n, max(n) OVER (PARTITION BY near.word) AS top FROM near JOIN words ON other = words.word) GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms
  UNION SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL
), last AS (SELECT chain.word, root FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""

OP13_SQL = r"""
WITH words AS (
  SELECT src, id, item FROM (
    SELECT 0 AS src, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS item
    FROM documents
    UNION ALL
    SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark)
), items AS (SELECT DISTINCT item FROM words), """ + CRC_SQL + r""", placed AS (
  SELECT src, id, crc % 10000 AS bucket, n FROM (SELECT src, id, item, count(*) AS n FROM words GROUP BY ALL) JOIN crcs USING (item)
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (src = 0), 0) AS s, coalesce(sum(n) FILTER (src = 1), 0) AS t FROM placed GROUP BY bucket
), sums AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS s_all, CAST(sum(t) AS DOUBLE) + 10000 AS t_all FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * s_all / ((CAST(s AS DOUBLE) + 1) * t_all))) AS BIGINT) AS gain FROM counts, sums
), weights AS (
  SELECT doc_id, coalesce(CAST(n AS BIGINT), 0) AS n_features, coalesce(CAST(w AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN (SELECT id, sum(n) AS n, sum(n * gain) AS w FROM placed JOIN gains USING (bucket) WHERE src = 0 GROUP BY id) ON doc_id = id
), scores AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""


def oracle_sql():
    return {"op11_spelling_variants": OP11_SQL, "op13_resample": OP13_SQL, "op2_warc": OP2_SQL, "op4_url_filters": OP4_SQL, "op3_exact_dedup": OP3_SQL, "op8_decontaminate": OP8_SQL}
