"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .ann import nearest
from .bpe_transducer import bpe_encode
from .conversation_trie import prefix_trie, started_alike, turn_lists
from .ngram_join import ngram_groups
from .packing import pack_documents
from .periodic_runs import longest, periodic_runs
from .quality_mil import held_out, score, train
from .quality_rules import BOILERPLATE, MOST_MARKS, clean_lines
from .shared import WORD, materialise, table
from .simhash import near_duplicates
from .suffix_dedup import suffix_dedup
from .token_files import read_token_files, write_token_files
from .url_filter import judge_urls
from .warc import read_warc, write_warc

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), special=True)
    return read_token_files(spark, folder, files, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = write_warc(table(spark, sf_dir, "pages"))
    records = read_warc(spark, folder, files=files).where("kind in ('response', 'revisit')")
    return records.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_encode(table(spark, sf_dir, "documents"), path, pattern, round_trip=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's operator on redirects between neighbours in the table of pages, as the given pages have no links."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    steps = pages.where("page_id % 8 <> 7 and page_id % 5 <> 0")
    redirects = steps.select(F.col("url").alias("a"), (F.col("page_id") + 1).alias("page_id")).join(pages.withColumnRenamed("url", "b").hint("merge"), "page_id").select("a", "b")
    return judge_urls(pages, URL_RULES, redirects, html=None).select("page_id", "host", "path", "rule", "verdict")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = nearest(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, special=True)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = materialise(turn_lists(table(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv_id")
    return prefix_trie(started_alike(lists, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: of one document in ten, by the crc32 of its id, the words from some place on repeat a few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(w)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_token_files, op3_warc, op4_simhash_near_dedup, op5_quality_rules, op6_byte_bpe, op7_quality_classifier, op8_url_filter, url_aliases, op9_nearest_neighbours, op10_packing, op11_conversation_trie, op12_ngram_jaccard_join, op13_periodic_runs)
}

def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda i: (ascii({text}[i // 8 + 1]) >> CAST(i % 8 AS INTEGER)) & 1)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({bits}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT))"


_W = r"[^\x20\x09-\x0D]+"
_PHRASES = "|".join(BOILERPLATE).replace("'", "''")

ORACLE: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM t)),
g AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)) GROUP BY doc_id, k),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1),
e AS (SELECT doc_id, b, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_prepend(CAST(0 AS BIGINT), coalesce(z, [])) AS starts, list_append(coalesce(a, []), n) AS ends FROM t LEFT JOIN l USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(list_reduce(list_prepend(CAST('' AS BLOB), list_transform(list_zip(starts, ends), lambda x: CASE WHEN x[2] > x[1] THEN array_slice(b, x[1] + 1, x[2]) ELSE CAST('' AS BLOB) END)), lambda x, y: x || y)) AS kept_sha256 FROM e
""",
    "op3_warc": """
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 5) AS BITSTRING)::INT], '' ORDER BY i) FROM range(32) r(i)) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BITSTRING) AS VARCHAR) AS bits FROM pages)
""",
    "op5_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS l FROM t),
c AS (SELECT *, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS g FROM w),
d AS (SELECT doc_id, list(x) AS again FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(g) AS x FROM c) GROUP BY ALL) WHERE n > 1 GROUP BY 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i, again FROM c JOIN d USING (doc_id)) WHERE list_contains(again, x)) GROUP BY 1),
f AS (SELECT doc_id, CAST(sum(length(x)) AS BIGINT) AS total, CAST(sum(CASE WHEN fails THEN length(x) ELSE 0 END) AS BIGINT) AS lost FROM (SELECT doc_id, x, letters = 0 OR marks * 100 > letters * {MOST_MARKS} OR bars >= 3 OR (words <= 30 AND regexp_matches(x, '(?i)(^|[^0-9A-Za-z_])(?:{_PHRASES})($|[^0-9A-Za-z_])')) OR filler AS fails FROM
  (SELECT doc_id, x, length(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS letters, length(regexp_replace(x, '[^#*$%&|<>~^={{}}\\]+', '', 'g')) + len(regexp_extract_all(x, '[!?]{{2,}}')) AS marks,
   len(regexp_extract_all(x, '[\x20\x09-\x0D][|»›>→•·][\x20\x09-\x0D]')) AS bars, len(regexp_extract_all(x, '{_W}')) AS words, len(list_filter(range(1, len(ws) - 2), lambda i: ws[i] = ws[i + 1] AND ws[i] = ws[i + 2] AND ws[i] = ws[i + 3])) > 0 AS filler
   FROM (SELECT doc_id, x, regexp_extract_all(x, '{_W}') AS ws FROM (SELECT doc_id, unnest(l) AS x FROM w)))) GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, total, lost FROM w LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT lost > total * 0.3 AS kept FROM b
""",
    "op8_url_filter": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
    "url_aliases": r"""
WITH RECURSIVE u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
k AS (SELECT *, lower(regexp_extract(url, '^(.*?)://', 1, 's')) || '://' || host || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS key FROM u),
rules(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
steps AS (SELECT x.key AS a, y.key AS b FROM k AS x JOIN k AS y ON y.page_id = x.page_id + 1 WHERE x.page_id % 8 <> 7 AND x.page_id % 5 <> 0),
edges AS (SELECT a, b FROM steps UNION SELECT b, a FROM steps),
reach(a, b) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
passed AS (SELECT r.a AS key, bool_or(m.a = 'block') AS blocked, bool_or(m.a = 'allow') AS allowed FROM reach r JOIN k ON k.key = r.b JOIN m USING (page_id) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(a, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict FROM k LEFT JOIN m USING (page_id) LEFT JOIN passed USING (key)
""",
    "op9_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, u.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM u AS q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 10
""",
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i FROM t),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 100 AS base, h, least(h, coalesce(b.n, 0)) AS head FROM (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM n) n LEFT JOIN n AS b ON b.conv_id = n.conv_id - n.conv_id % 100),
r AS (SELECT c.conv_id, i AS d, id, chars FROM c JOIN k ON k.conv_id = base AND i <= h UNION ALL SELECT c.conv_id, head + i - h, id, chars FROM c JOIN k USING (conv_id) WHERE i > h),
m AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS chars FROM c UNION ALL SELECT conv_id, d, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d), chars FROM r),
v AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY 1),
kids AS (SELECT left(path, -32) AS path, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n, 0) AS n_children FROM v LEFT JOIN kids USING (path)),
s AS (SELECT left(path, 32 * a) AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM w) GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM m JOIN (SELECT conv_id, max(d) AS d FROM m GROUP BY 1) USING (conv_id, d) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256 FROM w JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN v AS p ON w.depth > 0 AND p.path = left(w.path, -32)
""",
    "op12_ngram_jaccard_join": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * same >= 85 * (nx.n + ny.n - same)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) USING (doc_id)
""",
    "op13_periodic_runs": rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
h AS (SELECT *, len(w) AS n, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM t), g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h),
d AS (SELECT id, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
x AS (SELECT id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT id, w, unnest(range(CAST(len(w) AS BIGINT) - 5)) AS i FROM d)),
r AS (SELECT id, s FROM x GROUP BY ALL HAVING count(*) > 1), y AS (SELECT x.* FROM x SEMI JOIN r USING (id, s)),
p AS (SELECT b.id, a.i, b.i - a.i AS q FROM y AS a JOIN y AS b ON a.id = b.id AND a.s = b.s AND a.i < b.i),
f AS (SELECT id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS part FROM p) GROUP BY id, q, part),
runs AS (SELECT id, s, e, min(q) AS q FROM f WHERE e - s >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
b AS (SELECT id, count(*) AS n_runs, arg_min({{'s': s, 'n': e - s, 'q': q}}, {{'a': s - e, 'b': s, 'c': q}}) AS best, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT id, unnest(range(s + q, e)) AS i FROM runs),
l AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) ANTI JOIN gone USING (id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (id) LEFT JOIN l USING (id)
""",
}
