"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, chat, collocations, filter_audit, mixing, near_dedup, order_minhash, secrets, simhash, toxicity, url_filters, warc
from quern.storage import Scratch

#: The rule list of ``op1_url_filters``: host, path, verdict.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MIX_SEED = 7
CONTROL_TALK = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, seed=MIX_SEED).withColumn("rate", F.round("rate", 9))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    path = scratch.path("archives")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.records(spark, path)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    talk = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TALK), (-1, 1, "assistant", CONTROL_TALK)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.read_back(Scratch(spark, "op6").save(chat.format_turns(rows.unionByName(talk)), "pieces"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def tokenizer_path() -> str:
    """The byte-level vocabulary file that ``op9_bpe`` and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_documents(docs, tokenizer_path(), keep_ids=False, keep_text=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_op1() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT rid, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS n
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.rid = best.rid AND n = 1"""


def _sql_op2() -> str:
    """Of tables where every row has a doc_id of its own."""
    unit = f"""('0x' || substr(md5('{MIX_SEED}:' || d.doc_id || CASE WHEN i = 0 THEN '' ELSE ':part:' || i END), 1, 12))::BIGINT / 281474976710656.0"""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT count(*) FROM documents) / (SELECT count(*) FROM sizes)::DOUBLE / n_docs AS rate FROM sizes),
split AS (SELECT source, rate, greatest(ceil(rate / {mixing.PART_RATE}), 1)::BIGINT AS parts FROM rates),
cdf AS (
  SELECT source, rate, parts, rate / parts AS r, 0 AS k, -(rate / parts) AS log_p, exp(-(rate / parts)) AS cum FROM split
  UNION ALL
  SELECT source, rate, parts, r, k + 1, log_p + ln(r) - ln(k + 1), cum + exp(log_p + ln(r) - ln(k + 1))
  FROM cdf WHERE k < ceil(r + 12 * sqrt(r) + 30)),
lists AS (SELECT source, any_value(rate) AS rate, any_value(parts) AS parts, list(cum ORDER BY k) AS cums FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, rate, list_sum(list_transform(range(parts), lambda i: len(list_filter(cums, lambda c: c <= {unit})))) AS copies
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, replica::INTEGER AS replica, round(rate, 9) AS rate,
  md5('{MIX_SEED}:' || doc_id || ':' || replica) AS shuffle_key
FROM drawn, unnest(range(copies::BIGINT)) AS u(replica)"""


def _sql_op4() -> str:
    """Of tables where every row has a doc_id of its own: all sets against all, closed step by step."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM g GROUP BY doc_id),
r AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY name),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN r ra ON ra.rep = a.doc_id JOIN g b ON b.s = a.s JOIN r rb ON rb.rep = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(ra.n, rb.n) >= 80 * greatest(ra.n, rb.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(ra.n) + any_value(rb.n) - count(*))),
c AS (SELECT rep AS a, rep AS b FROM r UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
k AS (SELECT a, min(b) AS root FROM c GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id, w.doc_id = coalesce(root, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (name) LEFT JOIN k ON k.a = r.rep"""


def _sql_op5() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k"""


def _sql_op6() -> str:
    import re

    pattern = _quoted(r"\\|" + "|".join(re.escape(c) for c in chat.CONTROL))
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_quoted(CONTROL_TALK)} UNION ALL SELECT -1, 1, 'assistant', {_quoted(CONTROL_TALK)})
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + len(regexp_extract_all(role, {pattern})) + len(regexp_extract_all(text, {pattern}))
    + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def _sql_op8() -> str:
    parts = []
    for order, rule in enumerate(secrets.RULES):
        p = _quoted(rule.pattern)
        parts.append(f"""
  SELECT rid, '{rule.kind}' AS kind, {order} AS ord, own,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS b,
    length(hits[i]) AS n
  FROM (SELECT rid, i, gaps, hits, length(groups[i]) AS own FROM (
    SELECT rid, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {rule.group}) AS groups
    FROM d WHERE regexp_matches(t, {p})), unnest(range(1, len(hits) + 1)) AS u(i))
  WHERE own >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    kinds = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    one = "kind || ':' || b || ':' || (b + n)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT rid, {counts}, string_agg({one}, ',' ORDER BY b, ord) FILTER (kind IN ({kinds})) AS base,
    string_agg({one}, ',' ORDER BY b, ord) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


def _sql_op12() -> str:
    """Of tables where no row repeats a doc_id."""
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS copy FROM t),
m AS (SELECT f.doc_id, part, coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS toxic, map {{
  'A': len(w) < {filter_audit.LEAST_WORDS}, 'B': 100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': copy > 1}} AS fails
  FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter, fails[filter_order[step]] AS here, good, toxic,
    len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS before,
    len(list_filter(map_values(fails), lambda x: x)) AS failed
  FROM m, o, unnest(range(1, 6)) AS u(step)),
g AS (
  SELECT part, filter_order, step, filter, count(*) FILTER (NOT here AND NOT before)::BIGINT AS kept, count(*) FILTER (here AND NOT before)::BIGINT AS removed,
    count(*) FILTER (here AND before)::BIGINT AS redundant, count(*) FILTER (here AND failed = 1)::BIGINT AS unique_fails,
    count(*) FILTER (here AND NOT before AND good)::BIGINT AS good_lost, count(*) FILTER (here AND NOT before AND toxic)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g"""


def _sql_op13(least: int = 10, top: int = 2000) -> str:
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, w[i : i + k - 1] AS w, count(*)::HUGEINT AS f
  FROM p, unnest(range(1, 4)) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE len(w) > 1 AND f >= {least}),
s AS (
  SELECT c.lang, c.w, c.f AS a, a.f AS l, b.f AS r, 1000000 * c.f * c.f // (a.f * b.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.w ORDER BY 1000000 * c.f * c.f // (a.f * b.f), k) AS cut
  FROM c, unnest(range(1, len(c.w))) AS u(k)
  JOIN g a ON a.lang = c.lang AND a.w = c.w[1 : k] JOIN g b ON b.lang = c.lang AND b.w = c.w[k + 1 :]),
h AS (
  SELECT lang, w, max(f) AS f FROM (
    SELECT lang, w[1:2] AS w, f FROM c WHERE len(w) = 3 UNION ALL SELECT lang, w[2:3], f FROM c WHERE len(w) = 3) GROUP BY lang, w),
k AS (SELECT s.* FROM s LEFT JOIN h ON h.lang = s.lang AND h.w = s.w WHERE cut = 1 AND (h.f IS NULL OR 100 * h.f < 50 * a)),
z AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM k)
SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": _sql_op1(),
        "op2_mixing": _sql_op2(),
        "op4_near_dedup": _sql_op4(),
        "op5_warc": _sql_op5(),
        "op6_chat": _sql_op6(),
        "op8_secrets": _sql_op8(),
        "op12_filter_audit": _sql_op12(),
        "op13_collocations": _sql_op13(),
    }
