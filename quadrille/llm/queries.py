"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from quadrille.llm import (decontaminate, divergence, hard_negatives, host_reputation, html_text, language_gru, mixing, near_dedup, personal_data,
                           repetition, suffix_dedup, token_output, warc_fixity)
from quadrille.llm.common import fresh_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.measured(docs).select(
        "doc_id", *[f"repetition.{c}" for c in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _op2_sql() -> str:
    rules = repetition.DEFAULT
    longest = max(n for n, _ in rules.ngram_percent)
    grams = ", ".join(f"CASE WHEN i + {n} <= n_words + 1 THEN {' || chr(32) || '.join(['w'] + [f'lead(w, {k}) OVER o' for k in range(1, n)])} END AS g{n}"
                      for n, _ in rules.ngram_percent)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS t{n}" for n, _ in rules.ngram_percent)
    inside = ", ".join(f"max(t{n}::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
                       for n, _ in rules.ngram_percent)
    sums = ", ".join(f"sum(c{n} * length(w)) AS chars{n}" for n, _ in rules.ngram_percent)
    within = " AND ".join(f"100 * coalesce(chars{n}, 0) <= {p} * coalesce(word_chars, 0)" for n, p in rules.ngram_percent)
    assert longest >= repetition.BASE_LENGTH
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n_words FROM l),
g AS (SELECT doc_id, i, w, {grams} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, w, {twice} FROM g),
c AS (SELECT doc_id, i, w, {inside} FROM t),
m AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c5) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
lw AS (SELECT doc_id, length(line) AS size, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again
       FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lm AS (SELECT doc_id, sum(again::INT) AS n_dup_lines, sum(size) AS line_chars, sum(again::INT * size) AS dup_line_chars FROM lw GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars,
             {", ".join(f"chars{n}" for n, _ in rules.ngram_percent)}
      FROM d LEFT JOIN m USING (doc_id) LEFT JOIN lm USING (doc_id)),
v AS (SELECT *, n_words < {repetition.BASE_MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * dup_line_chars <= {rules.line_percent} * line_chars AND 100 * n_symbols <= {rules.symbol_percent} * n_words AND {within} AS kept
FROM v"""


QUERIES["op2_repetition_rules"], SQL["op2_repetition_rules"] = op2_repetition_rules, _op2_sql()


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document its path names (``/en/825``)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    named = host_reputation.with_parts(pages).select("page_id", F.regexp_extract("path", "/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    outcomes = named.join(labels, "doc_id").select("page_id", "bad")
    return host_reputation.judged(pages, outcomes).drop("bound")


def _op6_sql() -> str:
    limits = host_reputation.Limits()
    rules = sorted(host_reputation.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in rules) + " END"

    def shrunk(name: str, children: str, parents: str, by: str, keep: str) -> str:
        return f"""
{name}_c AS (SELECT c.*, parent FROM {children} c JOIN {parents} USING ({by})),
{name}_s AS (SELECT {by}, parent AS m, sum(round(n * (b / n - parent) * (b / n - parent) * 1000000)::BIGINT) AS ss, sum(n) AS sn, count(*) AS k
             FROM {name}_c GROUP BY {by}, parent),
{name}_v AS (SELECT {by}, m, greatest(0.0::DOUBLE, (ss / 1000000 - k * m * (1 - m)) / sn) AS var FROM {name}_s),
{name}_p AS (SELECT {by}, least(greatest(CASE WHEN var > 0 THEN m * (1 - m) / var - 1 ELSE {limits.strongest}::DOUBLE END, {limits.weakest}::DOUBLE), {limits.strongest}::DOUBLE) AS strength FROM {name}_v),
{name} AS (SELECT {keep}, n, strength, (b + strength * parent) / (n + strength) AS mean FROM {name}_c JOIN {name}_p USING ({by}))"""

    return rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, regexp_extract(host, '([^.]*)$', 1) AS suffix, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain,
             TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM p0),
o AS (SELECT page_id, any_value(host) AS host, any_value(domain) AS domain, any_value(suffix) AS suffix, max(1 - quality) AS bad
      FROM p JOIN labels USING (doc_id) WHERE host <> '' AND quality IS NOT NULL GROUP BY page_id),
hosts AS (SELECT '' AS root, suffix, domain, host, count(*) AS n, sum(bad) AS b FROM o GROUP BY ALL),
domains AS (SELECT root, suffix, domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT root, suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
top AS (SELECT root, sum(b) / sum(n) AS parent FROM suffixes GROUP BY root),
{shrunk("s0", "suffixes", "top", "root", "suffix")},
s1 AS (SELECT suffix, mean AS parent FROM s0),
{shrunk("d0", "domains", "s1", "suffix", "suffix, domain")},
d1 AS (SELECT suffix, domain, mean AS parent FROM d0),
{shrunk("h0", "hosts", "d1", "suffix, domain", "host")},
known AS (SELECT host, mean - {limits.deviations} * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM h0)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bound > {limits.bad_rate} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN known USING (host)"""


QUERIES["op6_host_reputation"], SQL["op6_host_reputation"] = op6_host_reputation, _op6_sql()


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = fresh_path(spark, "token-ids")
    token_output.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.summary(spark, path)


QUERIES["op9_token_output"] = op9_token_output


def op5_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), near_dedup.Banding(words=4))


def near_classes_sql(documents: str, words: int) -> str:
    """Exact classes by counting the shingles that two texts share."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
s0 AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(generate_series(1, len(ws) - {words - 1}), lambda i: array_to_string(ws[i:i + {words - 1}], ' '))) END AS ss FROM w),
reps AS (SELECT list_sort(ss) AS ss, min(doc_id) AS id FROM s0 WHERE len(ss) > 0 GROUP BY 1),
home0 AS (SELECT s0.doc_id, len(s0.ss) AS n, coalesce(reps.id, s0.doc_id) AS id FROM s0 LEFT JOIN reps ON list_sort(s0.ss) = reps.ss),
x AS (SELECT id, len(ss) AS n, unnest(ss) AS s FROM reps),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.s = b.s AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT id, id AS c FROM reps UNION SELECT e.b AS id, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
root AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
classes AS (SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM home0 LEFT JOIN root USING (id))"""


QUERIES["op5_minhash_classes"] = op5_minhash_classes
SQL["op5_minhash_classes"] = f"WITH RECURSIVE {near_classes_sql('documents', 4)} SELECT * FROM classes"


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.sampled(docs).select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens",
                                       F.round("mix.probability", 6).alias("probability"), "mix.kept")


def mixing_sql(documents: str) -> str:
    mix, dims = mixing.Mix(), [d for d in mixing.DIMENSIONS if d in mixing.Mix().targets]
    out = rf"""
mix_d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
  CASE WHEN text IS NULL THEN NULL WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 50 > length(text) THEN 'markup'
       WHEN (length(text) - length(translate(text, '0123456789', ''))) * 50 > length(text) THEN 'numeric'
       WHEN length(text) < 600 THEN 'brief' ELSE 'prose' END AS topic,
  list_reduce(list_transform(string_split(substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8), ''),
              lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b)::DOUBLE / 4294967296.0 AS u FROM {documents}),
mix_0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, 1.0::DOUBLE AS weight FROM mix_d GROUP BY ALL)"""
    for d in dims:
        out += f""",
want_{d} AS MATERIALIZED (SELECT {d}, pow(t::DOUBLE, {mix.targets[d]}::DOUBLE) / (sum(pow(t::DOUBLE, {mix.targets[d]}::DOUBLE)) OVER ()) * (sum(t) OVER ())::DOUBLE AS wanted
  FROM (SELECT {d}, sum(tokens) AS t FROM mix_0 GROUP BY {d}))"""
    k = 0
    for _ in range(mix.rounds):
        for d in dims:
            out += f""",
mix_{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, weight * CASE WHEN have > 0 THEN wanted / have ELSE 1 END AS weight
  FROM mix_{k} c JOIN (SELECT {d}, sum(tokens * weight) AS have FROM mix_{k} GROUP BY {d}) h ON c.{d} IS NOT DISTINCT FROM h.{d}
  JOIN want_{d} w ON c.{d} IS NOT DISTINCT FROM w.{d})"""
            k += 1
    out += f", cap_0 AS MATERIALIZED (SELECT *, false AS capped, 0.0::DOUBLE AS scale FROM mix_{k})"
    for i in range(mix.scale_rounds):
        out += f""",
cap_{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, capped OR weight * s >= 1 AS capped, s AS scale
  FROM cap_{i}, (SELECT ({mix.budget}::DOUBLE * sum(tokens)::DOUBLE - sum(CASE WHEN capped THEN tokens ELSE 0 END)) / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE tokens * weight END) AS s FROM cap_{i}))"""
    return out + f""",
mix AS (SELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN capped THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, weight * scale)) END AS probability, u
  FROM mix_d d JOIN cap_{mix.scale_rounds} c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic IS NOT DISTINCT FROM c.topic)"""


QUERIES["op8_mixing_weights"] = op8_mixing_weights
SQL["op8_mixing_weights"] = (f"WITH {mixing_sql('documents')} SELECT doc_id, source, lang, topic, n_tokens, "
                             "round(probability, 6) AS probability, u < probability AS kept FROM mix")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op1_decontamination"] = op1_decontamination


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES["op7_personal_data"] = op7_personal_data


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


QUERIES["op3_html_extraction"] = op3_html_extraction

#: the second replica of op10: which pages have a changed byte there, and which can't be read
CHANGED, LOST = "page_id % 97 = 13", "page_id % 389 = 7"


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica derived from it."""
    kept = warc_fixity.records(table(spark, sf_dir, "pages"))
    first = written(warc_fixity.manifest(kept), "fixity-manifest")
    changed = kept.filter(f"NOT coalesce({LOST}, false)").withColumn(
        "record", F.when(F.expr(CHANGED), F.overlay("record", F.lit("X"), 40, 1)).otherwise(F.col("record")))
    # the replica is read at the offsets of the index
    hashes = changed.select("page_id", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("sha256"))
    second = first.select("page_id", "warc_file", "record_offset").join(hashes, "page_id")
    return warc_fixity.located(warc_fixity.audit(first, second), first).select(
        "page_id", "warc_file", "record_offset", "record_length", "expected_sha256", "actual_sha256", "status")


QUERIES["op10_merkle_fixity"] = op10_merkle_fixity
SQL["op10_merkle_fixity"] = f"""
WITH r AS (SELECT page_id, page_id // {warc_fixity.PAGES_PER_FILE} AS warc_file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
  || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
m AS (SELECT page_id, warc_file, coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset,
  strlen(record) AS record_length, sha256(record) AS expected_sha256, sha256(left(record, 39) || 'X' || substr(record, 41)) AS other FROM r)
SELECT page_id, warc_file, record_offset, record_length, expected_sha256, CASE WHEN NOT ({LOST}) THEN other END AS actual_sha256,
  CASE WHEN {LOST} THEN 'missing' ELSE 'changed' END AS status FROM m WHERE {CHANGED} OR {LOST}"""


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept_bytes")


QUERIES["op4_suffix_arrays"] = op4_suffix_arrays



def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                                                     .otherwise(F.col("label")).alias("label"))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


QUERIES["op11_hard_negatives"] = op11_hard_negatives
SQL["op11_hard_negatives"] = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.Mining.scale} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.Mining.positives})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= {hard_negatives.Mining.negatives}"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES["op12_source_divergence"] = op12_source_divergence
_SHARE = "1 + (1000000000 * (coalesce({n}, 0) + 2)::HUGEINT) // ({used} + 2 * {v})"
_GAP = "((p - q) * (p - q)) // (p + q)"
SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {divergence.Audit.least_docs}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, (SELECT count(*) FROM k WHERE k.lang = g0.lang) AS v FROM (SELECT DISTINCT lang FROM g) g0),
u AS (SELECT lang, source, coalesce(sum(n), 0) AS used FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS MATERIALIZED (SELECT u.lang, u.source, k.term, {_SHARE.format(n="c.n", used="u.used", v="l.v")} AS p, coalesce(c.n, 0) AS n
  FROM u JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = u.lang AND c.source = u.source AND c.term = k.term),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
w AS (SELECT a.lang, a.term, {_SHARE.format(n="a.n", used="x.used", v="l.v")} AS q FROM a JOIN l USING (lang) JOIN (SELECT lang, sum(n) AS used FROM c GROUP BY lang) x USING (lang)),
pv AS (SELECT s.lang, s.source, o.source AS item, sum({_GAP.replace("p", "s.p").replace("q", "o.p")}) AS value
  FROM s JOIN s o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
te AS (SELECT lang, source, 'term' AS part, term AS item, ({_GAP})::BIGINT AS value FROM s JOIN w USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pr
UNION ALL SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM te QUALIFY rank <= {divergence.Audit.top}"""


def op13_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_gru.learned(docs.filter(F.col("doc_id").isNotNull() & ~language_gru.held_out(F.col("doc_id"))))
    return language_gru.predicted(docs, net)


QUERIES["op13_byte_gru"] = op13_byte_gru

QUERIES["pipeline"] = corpus_pipeline.run
