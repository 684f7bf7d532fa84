"""Queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from foldmark.llm import (
    fingerprints, manifest, mixing, near_dups, pieces, quality, repeats, search, shards, token_files,
    toxicity, url_rules, warc,
)
from foldmark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM twice, range(3) AS r(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
  FROM w LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 4 * n_lines)::BIGINT
    + 16 * (2 * n_capitals > word_chars)::BIGINT + 32 * (2 * n_exclaims > n_words)::BIGINT
    + 64 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::BIGINT AS failed
  FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept FROM f
"""


@registered("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(quality.ledger(read_table(spark, folder, "documents")))


@registered("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return shards.by_bytes(read_table(spark, folder, "documents"), shards=24)


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
  SELECT h.*, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM h LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN regexp_matches(host,
  '\A(.*[.-])?(ads|adult|bets|bet|casino|poker|porn|xxx|pills|pharma|spam|track|tracker|warez)([.-]|\z)')
  THEN 'block' ELSE 'allow' END) AS verdict FROM fit WHERE k = 1
"""


@registered("op5_url_filters", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(read_table(spark, folder, "pages"))


@registered("op1_minhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, folder, "documents"),
                                     near_dups.Likeness(shingle=4))


@registered("op6_source_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(read_table(spark, folder, "documents"))


@registered("op7_suffix_array_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removal_counts(read_table(spark, folder, "documents"))


@registered("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(read_table(spark, folder, "documents"), path("piece_bpe_32k.model"),
                          with_ids=False)


@registered("op9_document_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_report(read_table(spark, folder, "documents"))


@registered("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@registered("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_report(read_table(spark, folder, "documents"),
                                    path("word_bpe_49k.json"), end=1)


# CRC-32 bit by bit: each byte, then seven steps without one.
CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    range(1, length(doc_id::VARCHAR) + 1),
    lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END))"""


def leaf_sql(text: str) -> str:
    values = [c if c == text else f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN xor({CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, source, {leaf_sql('text')} AS leaf, {leaf_sql('changed')} AS candidate FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM leaves
), low AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY k) AS d FROM placed GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, (len(d) + 2) // 3),
    lambda i: sha256(array_to_string(d[3 * i + 1:3 * i + 3], ''))) FROM low WHERE len(d) > 1
), subs AS (
  SELECT source, d[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM low WHERE len(d) = 1
), high AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS d FROM subs
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(d) + 2) // 3),
    lambda i: sha256(array_to_string(d[3 * i + 1:3 * i + 3], ''))) FROM high WHERE len(d) > 1
), steps AS (
  SELECT doc_id, leaf, k, source, lvl, d[k // (3 ** lvl)::BIGINT // 3 * 3 + 1:k // (3 ** lvl)::BIGINT // 3 * 3 + 3] AS run,
    k // (3 ** lvl)::BIGINT % 3 + 1 AS own
  FROM (SELECT doc_id, leaf, k::BIGINT AS k, source FROM placed) JOIN low USING (source)
  WHERE len(d) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.k, p.source, 1000 + lvl,
    d[place // (3 ** lvl)::BIGINT // 3 * 3 + 1:place // (3 ** lvl)::BIGINT // 3 * 3 + 3], place // (3 ** lvl)::BIGINT % 3 + 1
  FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source, high WHERE len(d) > 1
), pieces AS (
  SELECT *, array_to_string(run[1:own::BIGINT - 1], '') AS before,
    array_to_string(run[own::BIGINT + 1:3], '') AS after FROM steps
), paths AS (
  SELECT source, k, list({{'b': before, 'a': after}} ORDER BY lvl) AS path FROM pieces GROUP BY source, k
)
SELECT p.doc_id, p.leaf, s.subroot, h.d[1] AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
  list_reduce(coalesce(path, []), lambda acc, x: {{'b': '', 'a': sha256(x.b || acc.a || x.a)}},
              {{'b': '', 'a': candidate}}).a AS folded_root,
  list_reduce(coalesce(path, []), lambda acc, x: {{'b': '', 'a': sha256(x.b || acc.a || x.a)}},
              {{'b': '', 'a': candidate}}).a = h.d[1] AS verified
FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source
LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM p.source AND paths.k = p.k
JOIN high h ON len(h.d) = 1
"""


@registered("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audit(read_table(spark, folder, "documents"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, rowid_, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), tf AS (
  SELECT doc_id, rowid_, t, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT rowid_, count(*)::BIGINT AS n FROM words GROUP BY ALL
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), df AS (
  SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), parts AS (
  SELECT item_id, doc_id, rowid_, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS part
  FROM wanted JOIN tf USING (t) JOIN df USING (t) JOIN sizes USING (rowid_), whole
), scored AS (
  SELECT item_id, doc_id, rowid_, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""


@registered("op12_ranked_search", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), last AS (
  SELECT body, max(page_id) AS last FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN last IS DISTINCT FROM page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p LEFT JOIN last USING (body)
"""


@registered("op13_warc", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_report(read_table(spark, folder, "pages"))
