"""DuckDB equivalents of the operator queries that SQL can express.

The others (token shards, BPE, mixing, the suffix tree, token counts, the
classifier) are drawn, learned or tokenised; tests hold them against brute
force.
"""

from __future__ import annotations

from tandem.llm.spotsigs import ANCHOR_PATTERN, CHAIN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base 32

MINHASH = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS sh FROM w
), each_one AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM each_one a JOIN each_one b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

WARC = f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS fives, max(page_id) OVER (PARTITION BY h, n) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(fives, lambda x: substr('{ALPHABET}', (x >> 15) % 32 + 1, 1) || substr('{ALPHABET}', (x >> 10) % 32 + 1, 1)
    || substr('{ALPHABET}', (x >> 5) % 32 + 1, 1) || substr('{ALPHABET}', x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, nullif(url, '') AS requested_url, n::BIGINT AS fetched_bytes
FROM d
"""

EMBEDDING = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""


def _signatures(text: str) -> str:
    spaced = rf"' ' || replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ', '  ') || ' '"
    marked = rf"regexp_replace(regexp_replace({spaced}, '{ANCHOR_PATTERN}', E'\n\\1 ', 'g'), ' +', ' ', 'g')"
    chains = rf"list_filter(regexp_extract_all({marked}, E'[^ \n]+(?: [^ \n]+){{{{0,{CHAIN - 1}}}}}'), lambda p: contains(p, ' '))".replace("{{", "{").replace("}}", "}")
    return f"list_transform([{chains}], lambda c: list_sort(list_distinct(list_transform(CASE WHEN len(c) > 0 THEN c WHEN {text} = '' THEN [] ELSE [E'\\n' || {text}] END, lambda s: substr(md5(s), 1, 12)))))[1]"


def _alike(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    whole = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {whole} = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / {whole} END"


SPOTSIGS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d
), e AS (SELECT *, substring(text, 1, n - n // 3) || substring(nxt, 1, n // 3) AS edited FROM o),
s AS (SELECT *, {_signatures("text")} AS a, {_signatures("edited")} AS b, {_signatures("nxt")} AS c FROM e)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_alike("a", "b")} AS near_edited, {_alike("a", "c")} AS near_next
FROM s
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS named
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, sha256('0:' || named)) AS said, {_CRC32} % 9 AS h FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), members AS (SELECT conv_id, unnest(range(0, len(said) + 1)) AS depth, said FROM rebuilt),
prefixes AS (SELECT conv_id, depth, said[1:depth] AS said, len(said) = depth AS ends FROM members),
nodes AS (
  SELECT depth, said, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(any_value(said[depth].text))) END AS saved
  FROM prefixes GROUP BY depth, said
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.said[1:n.depth] = n.said) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.said = n.said[1:n.depth - 1]
), below AS (
  SELECT n.conv_id, n.depth, count(*) FILTER (s.n_children = 0) AS n_leaves, sum(s.saved) AS saved_tokens
  FROM linked n JOIN linked s ON s.depth >= n.depth AND s.said[1:n.depth] = n.said GROUP BY n.conv_id, n.depth
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN below USING (conv_id, depth)
"""

_SQL = {"op3_minhash": MINHASH, "op4_warc": WARC, "op6_embedding_dedup": EMBEDDING, "op9_spotsigs": SPOTSIGS, "op11_prefix_trie": PREFIX_TRIE}


def oracles() -> dict[str, str]:
    return dict(_SQL)
