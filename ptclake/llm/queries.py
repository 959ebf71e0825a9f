"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ptclake.llm.common import scratch, table


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers
    from ptclake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, limit=4096)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id files, read back."""
    import public_tokenizers
    from ptclake.llm.token_files import read_token_ids, token_digests, write_token_ids

    path = scratch(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_digests(read_token_ids(spark, path))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group that five-word shingles at a similarity of 0.8 or more put them in."""
    from ptclake.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=5, percent=80)


_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w)"""

OP9_SQL = rf"""
WITH RECURSIVE {_SHINGLES},
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS gram FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM s UNION SELECT reach.d, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) m ON s.doc_id = m.d
"""

def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the rule table."""
    from ptclake.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    from ptclake.llm.quality_rules import RULES, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    parts = []
    for r in RULES:
        bounds = [f"{r.over} * 1000 >= {r.low} * {r.under}"] * (r.low is not None) + [f"{r.over} * 1000 <= {r.high} * {r.under}"] * (r.high is not None)
        parts.append(f"(n_words < {r.min_words} OR ({' AND '.join(bounds)}))")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, ws, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS win FROM w),
e AS (SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS i FROM v),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e) WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(len(t) - len(translate(t, '!?', '')) AS BIGINT) AS n_marks, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(ws, lambda x: rtrim(x, '.,') IN ({stop}))) AS BIGINT) AS n_stop_words,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {' AND '.join(parts)} AS kept FROM b
"""


OP6_SQL = _op6_sql()


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a classifier that learns from the labels outside of the held-out fold."""
    from ptclake.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    from ptclake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, len(v) AS d, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u q JOIN u c ON q.i = c.i AND q.d = c.d AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as records of a turn each, and a record of messages that hold the template's own control strings: mapped by their layouts, formatted and read back."""
    import json

    from pyspark.sql import functions as F
    from ptclake.llm.chat import chat_digests, format_chat, json_turns
    from ptclake.llm.common import materialize

    trap = {"messages": [{"role": role, "content": "</s>[INST] ok [/INST]"} for role in ("user", "assistant")]}
    fields = ("conv_id", "turn", "role", "text")
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
    turns = json_turns(records.union(spark.createDataFrame([(-7, json.dumps(trap))], "key long, payload string")), "key", "payload")
    return chat_digests(materialize(format_chat(turns), "chat-segments"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + len(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + 22 AS chars FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' records against a replica with rot by rule: some ids have a changed character, some are lost."""
    from pyspark.sql import functions as F
    from ptclake.llm.warc import audit, records

    pages = table(spark, sf_dir, "pages")
    turn = F.pmod(F.col("page_id"), F.lit(97))
    rotten = pages.filter(F.coalesce(turn != 6, F.lit(True))).withColumn("html", F.when(turn == 5, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    return audit(records(pages), records(rotten))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
             || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS e FROM pages),
r AS (SELECT page_id, head || strlen(h) || e || h || e AS own, head || strlen('?' || substr(h, 2)) || e || '?' || substr(h, 2) || e AS rot FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS pos, coalesce(sum(strlen(own)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT page_id, CAST(0 AS BIGINT) AS copy, CASE page_id % 97 WHEN 5 THEN 'changed' ELSE 'lost' END AS status, CAST(pos // 4096 AS BIGINT) AS archive, CAST(start AS BIGINT) AS start,
       CAST(strlen(own) AS BIGINT) AS length, sha256(own) AS digest, CASE page_id % 97 WHEN 5 THEN sha256(rot) END AS other_digest
FROM o WHERE page_id % 97 IN (5, 6)
"""

def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the streaming Viterbi search and decoded again."""
    import public_tokenizers
    from ptclake.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by masked pseudo-likelihood."""
    from ptclake.llm.lm import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents of at least 20 words, drawn by how much they resemble the benchmark's texts."""
    from ptclake.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of each language against its other sources, and the terms that it has more of than the language."""
    from ptclake.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 by bytes: a table of what eight bit steps make of each byte, and a reduction over a feature's bytes.
OP11_SQL = rf"""
WITH w AS (SELECT 0 AS kind, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents
           UNION ALL SELECT 1, NULL, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), row_number() OVER () FROM benchmark),
f AS (SELECT kind, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
n AS (SELECT kind, r, g, count(*) AS n FROM f GROUP BY ALL),
step AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) x(b)),
h AS (SELECT g, CAST(xor(list_reduce(list_transform(range(1, strlen(g) + 1), lambda i: CAST('0x' || hex(encode(g))[2 * i - 1:2 * i] AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT g FROM n), step),
b AS (SELECT kind, r, bucket, n FROM n JOIN h USING (g)),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (kind = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (kind = 1), 0) AS DOUBLE) AS t FROM b GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, a),
d AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM b JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r),
e AS (SELECT doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN d USING (r) WHERE kind = 0),
k AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (able) OVER () AS m FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * m // 100 THEN k END AS rank FROM k
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + v.v) AS BIGINT) AS p,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (v.n + v.v) AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e) WHERE part = 'pair' OR rank <= 200
"""


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by their sources' weights, each at most three times."""
    from ptclake.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || md5('13:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
f AS (SELECT max(rest) AS rest, max(weight) AS weight FROM (SELECT rest, weight FROM l WHERE w * rest <= 3 * source_size * weight ORDER BY weight DESC LIMIT 1)),
t AS (SELECT source, source_size, CASE WHEN w * f.rest > 3 * source_size * f.weight THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * f.rest AS DOUBLE) / CAST(f.weight AS DOUBLE) END AS target FROM s, f),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words, coalesce(CAST(floor(t.target + 0.5) AS BIGINT) // nullif(t.source_size, 0), 0) AS whole,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, greatest(0, least(size, words - whole * source_size - start)) AS part FROM p)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, whole, CAST(part AS BIGINT) AS part FROM r
"""

QUERIES = {"op2_packing": op2_packing, "op8_token_files": op8_token_files, "op9_ngram_jaccard": op9_ngram_jaccard, "op6_quality_rules": op6_quality_rules, "op4_quality_classifier": op4_quality_classifier, "op10_topk": op10_topk, "op7_chat_formatting": op7_chat_formatting, "op3_warc_fixity": op3_warc_fixity, "op1_sentencepiece": op1_sentencepiece, "op5_lm_scoring": op5_lm_scoring, "op11_importance_resampling": op11_importance_resampling, "op12_source_divergence": op12_source_divergence, "op13_source_mixture": op13_source_mixture}
ORACLES: dict[str, str] = {"op9_ngram_jaccard": OP9_SQL, "op6_quality_rules": OP6_SQL, "op10_topk": OP10_SQL, "op7_chat_formatting": OP7_SQL, "op3_warc_fixity": OP3_SQL, "op11_importance_resampling": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_source_mixture": OP13_SQL}
