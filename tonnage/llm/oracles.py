"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tonnage.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{_ITEM_WORDS}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low('text')}, '{_ITEM_WORDS}') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
seen AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(ws) - n + 2)) u(i) WHERE len(ws) >= n),
hits AS (SELECT doc_id, i, seen.n, item_id FROM seen JOIN windows USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(role) + length(': ') + length(escaped) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

URL_FILTER = f"""
WITH rules(h, p, verdict) AS (VALUES {', '.join(str(r) for r in RULES)}),
parts AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (SELECT DISTINCT host, path, first_value(h || p) OVER w AS rule, first_value(verdict) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM q) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  WINDOW w AS (PARTITION BY host, path ORDER BY length(h) + length(p) DESC, length(h) DESC, verdict DESC))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN best USING (host, path)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM d, unnest(range(1, len(ws) - 18)) u(i) WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, i, rank() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM starts),
gone AS (SELECT DISTINCT doc_id, j FROM ranked, unnest(range(i, i + 20)) u(j) WHERE place > 1),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS text
  FROM (SELECT doc_id, j, ws[j] AS w FROM d, unnest(range(1, len(ws) + 1)) u(j)) x ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FIELDS = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_ROW = " || ".join(_FIELDS.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: The last bit of crc32 of a decimal number: bytes, each followed by eight shifts (-1).
_ODD = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: list_concat([ord(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) & 1"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_ROW} || {_FIELDS.format('text')}) AS leaf,
    CASE WHEN {_ODD} = 1 THEN sha256({_ROW} || {_FIELDS.format("replace(text, chr(10), '')")}) END AS changed
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT source, 0 AS lvl, i, leaf AS d, n FROM ranked
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, i // 3, n),
tops AS (SELECT source, lvl, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, i, d, n FROM tops
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY lvl, i // 3, n),
own AS (SELECT row_number() OVER () AS r, k.*, t.lvl AS depth, t.d AS subroot, t.i AS place FROM ranked k JOIN tops t ON k.source IS NOT DISTINCT FROM t.source),
runs AS (
  SELECT r, t.lvl, t.i, t.d, t.i = o.i // CAST(pow(3, t.lvl) AS BIGINT) AS self
  FROM own o JOIN tree t ON t.source IS NOT DISTINCT FROM o.source AND t.lvl < o.depth AND t.i // 3 = o.i // CAST(pow(3, t.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT r, o.depth + c.lvl, c.i, c.d, c.i = o.place // CAST(pow(3, c.lvl) AS BIGINT)
  FROM own o JOIN crown c ON c.n > 1 AND c.i // 3 = o.place // CAST(pow(3, c.lvl + 1) AS BIGINT)),
proofs AS (SELECT r, sha256(coalesce(string_agg(d, '' ORDER BY lvl, i) FILTER (NOT self), '')) AS proof FROM runs GROUP BY r),
steps AS (SELECT r, lvl, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < me), '') AS low, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > me), '') AS high
  FROM (SELECT *, max(i) FILTER (self) OVER (PARTITION BY r, lvl) AS me FROM runs) x GROUP BY r, lvl),
fold AS (
  SELECT r, 0 AS lvl, coalesce(changed, leaf) AS d FROM own
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(s.low || f.d || s.high) FROM fold f JOIN steps s ON s.r = f.r AND s.lvl = f.lvl),
last AS (SELECT r, max_by(d, lvl) AS folded_root FROM fold GROUP BY r),
root AS (SELECT d AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM own JOIN last USING (r) LEFT JOIN proofs USING (r), root
"""
