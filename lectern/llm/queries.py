"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, conversations, embeddings, mixing, packing, quality, simhash, storage, suffix, tokenbin, urlfilter, warc


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(storage.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: Pairs of rows of a label, by cosine; components by walking the links.
OP1_SQL = """
WITH RECURSIVE x AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM x WHERE v IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(vec_id) AS least FROM r JOIN x ON x.k = r.b GROUP BY 1),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(least, vec_id)), false) AS kept FROM x LEFT JOIN n USING (k) LEFT JOIN c USING (k)
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = storage.table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.read(warc.write(pages, storage.fresh_dir(spark, "warc"))).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(storage.table(spark, sf_dir, "documents", "doc_id", "text"))


#: Every window of 200 bytes, by a hash of 64 bits; text as hexadecimal digits, two for a byte.
OP3_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(0, length(h) // 2 - 199), lambda i: hash(substr(h, 2 * i + 1, 400))) AS ks FROM d),
w AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(ks))) AS i, unnest(ks) AS k FROM l),
s AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, span),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS head FROM before JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(storage.table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(storage.table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(storage.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(storage.table(spark, sf_dir, "pages", "page_id", "url")).drop("url")


OP7_SQL = """
WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
j AS (SELECT b.*, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h) + length(r.p) DESC NULLS LAST, length(r.h) DESC) AS k
      FROM b LEFT JOIN r ON (b.host = r.h OR suffix(b.host, '.' || r.h)) AND starts_with(b.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(storage.table(spark, sf_dir, "documents", "doc_id", "text"), storage.table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents", "doc_id", "text")
    return tokenbin.read(tokenbin.write(docs, storage.fresh_dir(spark, "tokens")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(storage.table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(storage.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def _least(*options: str) -> str:
    """SQL of the cheapest way, of equal ones that with the ASCII-least audit. Ways are ``{c: cost, a: audit, r: repaired rows}``."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _way(edit: str, cost: str, after: str, row: str | None = None, when: str | None = None) -> str:
    """SQL of an edit before the way ``after``."""
    way = f"{{'c': {after}.c + {cost}, 'a': '{edit}' || {after}.a, 'r': {f'list_prepend({row}, {after}.r)' if row else f'{after}.r'}}}"
    return f"CASE WHEN {when} THEN {way} END" if when else way


def _op11_sql() -> str:
    """From the last row of each conversation to its first, the cheapest way from each state of the grammar: 1 nothing, 2 system, 3 user, 4 assistant."""
    then, kept = {1: 3, 2: 3, 3: 4, 4: 3}, {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    name, more = {3: "user", 4: "assistant"}, "CASE WHEN truncated THEN 3 ELSE 0 END"
    own = [_least(_way("D", "4", f"v[{q}]"), *(_way("K", f"({more})", f"v[{p}]", "role || ':' || text", f"NOT gone AND initial = '{i}'") for i, p in kept[q].items()), _way("R", f"(3 + {more})", f"v[{then[q]}]", f"'{name[then[q]]}:' || text", "NOT gone")) for q in then]
    insert = lambda v: "[" + ", ".join(_least(f"b[{q}]", _way("I", "3", f"{v}[{then[q]}]", f"'{name[then[q]]}:'")) for q in then) + "]"
    end = "[{'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 3, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::VARCHAR[]}]"
    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, xor(c, b))"
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('c' || conv_id, '') AS conv, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS signs FROM conversations),
hashed AS (SELECT *, xor(list_reduce(signs, lambda c, b: {step}, 4294967295), 4294967295) % 20 AS kind FROM keyed),
damaged AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i FROM damaged),
judged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM placed),
faulty AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, blank OR again AS gone, role[1] AS initial FROM judged),
counts AS (SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
ways AS (SELECT conv, n + 1 AS i, {end} AS v FROM counts
  UNION ALL SELECT conv, i, {insert('w')} FROM (SELECT *, {insert('b')} AS w FROM (SELECT f.conv, f.i, [{', '.join(own)}] AS b FROM ways JOIN faulty f ON f.conv = ways.conv AND f.i = ways.i - 1)))
SELECT DISTINCT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM keyed LEFT JOIN counts USING (conv) LEFT JOIN (SELECT * FROM ways WHERE i = 1) USING (conv)
"""


OP11_SQL = _op11_sql()


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(storage.table(spark, sf_dir, "documents", "doc_id", "text", "source"), with_text=False).taken()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(storage.table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_warc": op2_warc, "op3_suffix_array_dedup": op3_suffix_array_dedup, "op4_simhash": op4_simhash, "op6_multi_index_hashing": op6_multi_index_hashing, "op7_url_filter": op7_url_filter, "op5_bpe": op5_bpe, "op8_quality": op8_quality, "op9_token_output": op9_token_output, "op10_packing": op10_packing, "op11_conversation_repair": op11_conversation_repair, "op12_source_mixing": op12_source_mixing, "op13_token_alignment": op13_token_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op3_suffix_array_dedup": OP3_SQL, "op7_url_filter": OP7_SQL, "op11_conversation_repair": OP11_SQL}
