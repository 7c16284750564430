"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstat.llm import langid, lines, mixing, neardup, packing, pages, phrases, prefixes, quality, sharding, spans, topk, urls
from packstat.llm.common import read

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


@query
def op2_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_host_suffix_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages")
    return urls.judge(rows, urls.referred(rows))


@query
def op6_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)


@query
def op8_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query
def op11_twice_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


@query
def op12_turn_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_nodes(read(spark, sf_dir, "conversations"))


@query
def op13_burst_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = sorted(urls.RULES, key=lambda r: -len(r[1]))


def _fits(text: str) -> str:
    host, _, path = text.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


ORACLES["op5_bloom_cascade_urls"] = f"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
listed AS (SELECT DISTINCT host || path AS address FROM parts WHERE regexp_matches(url, '[?&]ref=')),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {_fits(t)} THEN '{t}'" for _, t in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(t)} THEN '{v}'" for v, t in _RULES)} END AS said FROM parts)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host || path IN (SELECT address FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""

ORACLES["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_LEFT = "t"
_CLASSES = []
for _pattern in quality.CLASSES:
    _next = f"regexp_replace({_LEFT}, '{_pattern.replace("'", "''")}', '', 'g')"
    _CLASSES.append(f"length({_LEFT}) - length({_next})")
    _LEFT = _next
_CLASSES.append(f"length({_LEFT})")
_COMMON = ", ".join(f"'{w}'" for w in quality.WORDS)

ORACLES["op1_divergence_rules"] = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i + 7] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, [{", ".join(_CLASSES)}] AS classes,
  list_transform([{_COMMON}], lambda k: len(list_filter(ws, lambda x: lower(x) = k))) AS listed
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep ON rep.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
bins AS (SELECT doc_id, lang, base_failed, 1 AS kind, unnest(classes) AS n, generate_subscripts(classes, 1) AS bin FROM judged
  UNION ALL SELECT doc_id, lang, base_failed, 2, unnest(listed || [n_words - list_sum(listed)]), generate_subscripts(listed || [0], 1) FROM judged),
enough AS (SELECT lang FROM judged WHERE NOT base_failed AND regexp_full_match(lang, '[a-z]{{2,3}}') GROUP BY lang HAVING count(*) >= {quality.LEAST_DOCUMENTS}),
ref AS (SELECT kind, bin, lang, sum(n) AS q FROM bins WHERE NOT base_failed AND lang IN (SELECT lang FROM enough) GROUP BY ALL
  UNION ALL SELECT kind, bin, NULL, sum(n) FROM bins WHERE NOT base_failed GROUP BY ALL),
known AS (SELECT doc_id, kind, bin, n, CASE WHEN lang IN (SELECT lang FROM enough) THEN lang END AS of_lang FROM bins),
shares AS (SELECT doc_id, known.kind, n / sum(n) OVER (PARTITION BY doc_id, known.kind) AS p, q / sum(q) OVER (PARTITION BY doc_id, known.kind) AS q
  FROM known JOIN ref ON ref.kind = known.kind AND ref.bin = known.bin AND ref.lang IS NOT DISTINCT FROM known.of_lang),
far AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
  FROM shares WHERE p = p AND q = q GROUP BY ALL),
wide AS (SELECT doc_id, max(js) FILTER (kind = 1) AS c, max(js) FILTER (kind = 2) AS w FROM far GROUP BY doc_id)
SELECT judged.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((word_chars >= {quality.LEAST_CHARS} AND coalesce(c, 0) > {quality.MOST_CHARS}) OR (n_words >= {quality.LEAST_WORDS} AND coalesce(w, 0) > {quality.MOST_WORDS})) AS kept
FROM judged LEFT JOIN wide USING (doc_id)
"""

ORACLES["op6_hamming_near_duplicates"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.least AS component_id, c.least = w.doc_id AS kept
FROM w JOIN c ON c.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

ORACLES["op2_debruijn_spans"] = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
first AS (SELECT g, min((doc_id, i)) AS f FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win JOIN first USING (g) WHERE (doc_id, i) <> f),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op11_twice_seen_lines"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
left_ AS (SELECT doc_id, line, i, key IN (SELECT key FROM shared) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM left_ GROUP BY doc_id
"""

# crc32 of the decimal conv_id, bit by bit
ORACLES["op12_turn_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS p FROM t),
bits AS (SELECT conv_id, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM bits),
r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o USING (conv_id) WHERE p > h),
path AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, p) FILTER (role IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
member AS (SELECT conv_id, turns, d, turns[1:d] AS node FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM path)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(any_value(turns[d].text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS saved FROM member GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS above, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS children FROM node LEFT JOIN kids ON kids.above = node.node AND kids.d = node.d),
below AS (SELECT top, k, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT saved, children, k, node[1:k] AS top FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_)) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN below ON below.top = f.node AND below.k = f.d LEFT JOIN node up ON f.d > 0 AND up.d = f.d - 1 AND up.node = f.node[1:f.d - 1]
"""

ORACLES["op13_burst_trie_phrases"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)),
x AS (SELECT lang, w AS one, w || ' ' || lead(w) OVER later AS two, w || ' ' || lead(w) OVER later || ' ' || lead(w, 2) OVER later AS three FROM w WINDOW later AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS size, one AS phrase FROM x UNION ALL SELECT lang, 2, two FROM x WHERE two IS NOT NULL UNION ALL SELECT lang, 3, three FROM x WHERE three IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cut AS (SELECT c.*, k FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.part = best.phrase WHERE f IS NULL OR 100 * f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
