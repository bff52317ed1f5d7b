"""SQL forms of the queries that SQL can express, written from their contracts.

No form: op1 and op11 (byte-pair encoding), op5 (edit groups over hashes of words), op7
and op8 (fitted scores). These are tested against brute force, round trips and held-out rows.
"""

from __future__ import annotations

from riskloom.llm import chat
from riskloom.llm.queries import DOMAINS, HARD_CHAT, MIX_EPOCHS, MIX_PERCENT, MIX_SEED, MIX_WEIGHTS

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM runs JOIN firsts USING (run) WHERE doc_id > first) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce((SELECT string_agg(w[k], ' ' ORDER BY k) FROM unnest(range(1, len(w) + 1)) r(k) WHERE NOT list_contains(places, k)), '')
  END) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""


def _weight(name: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(name, {}).items())
    return f"CASE {name} {whens} ELSE 1 END" if whens else "1"


def _divided(table: str, source: str, parent: str, name: str) -> str:
    """Children of each ``parent`` node filled up in order of capacity by weight."""
    node = f"PARTITION BY {parent}"
    order = f"{node} ORDER BY capacity / weight, {name}"
    return f"""{table}_f AS (
  SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM {source}),
{table} AS (
  SELECT *, CASE WHEN filled THEN capacity
    ELSE weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER ({node}), 0)) // (sum(weight) FILTER (NOT filled) OVER ({node}))
    END AS given
  FROM {table}_f)"""


_NUMBER = "TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), '') AS BIGINT) % 3"
MIXING = f"""
WITH docs AS (
  SELECT doc_id, CASE {_NUMBER} WHEN 0 THEN '{DOMAINS[0]}' WHEN 1 THEN '{DOMAINS[1]}' ELSE '{DOMAINS[2]}' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MIX_EPOCHS} AS capacity, {_weight('source')} AS weight
  FROM docs GROUP BY ALL),
langs AS (SELECT domain, lang, sum(capacity) AS capacity, {_weight('lang')} AS weight FROM leaves GROUP BY domain, lang),
domains AS (
  SELECT domain, sum(capacity) AS capacity, {_weight('domain')} AS weight,
    (SELECT sum(n_tokens) * {MIX_PERCENT} // 100 FROM docs) AS budget FROM langs GROUP BY domain),
{_divided('top', 'domains', '1', 'domain')},
langs_b AS (SELECT l.*, t.given AS budget FROM langs l JOIN top t USING (domain)),
{_divided('middle', 'langs_b', 'domain', 'lang')},
leaves_b AS (SELECT l.*, m.given AS budget FROM leaves l JOIN middle m USING (domain, lang)),
{_divided('bottom', 'leaves_b', 'domain, lang', 'source')},
keyed AS (
  SELECT d.*, b.given // b.tokens AS passes, b.given % b.tokens AS room,
    md5('{MIX_SEED}:' || CAST(b.given // b.tokens AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM docs d JOIN bottom b USING (domain, lang, source) WHERE b.given > 0),
ends AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, CAST(passes AS BIGINT))) AS BIGINT) AS epoch, n_tokens FROM keyed
UNION ALL
SELECT doc_id, domain, lang, source, CAST(passes AS BIGINT), n_tokens FROM ends WHERE room > 0 AND upto <= room
"""

DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT item_id, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases))),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN phrases USING (phrase) WHERE p.n = phrases.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HARD = ", ".join(f"({c}, {t}, {_quoted(r)}, {_quoted(x)})" for c, t, r, x in HARD_CHAT)
_ESCAPED = "(length({0}) + length(regexp_replace({0}, '[^\\\\<\\[]', '', 'g')))"
_FRAME = "CASE role " + " ".join(
    f"WHEN '{role}' THEN {len(t.before) + len(t.after)}" for role, t in chat.TEMPLATE.items()
) + f" ELSE {sum(map(len, chat.OTHER))} + {_ESCAPED.format('role')} END"
CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {_HARD}) h(conv_id, turn, role, text))),
placed AS (
  SELECT *, row_number() OVER o - 1 AS i, lag(role) OVER o AS before FROM turns
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN i = 0 THEN role IN ('system', 'user')
    ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS fits FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_FRAME} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars,
  bool_and(fits) AND arg_max(role, i) = 'assistant' AS valid, min(i) FILTER (NOT fits) AS first_fault
FROM judged GROUP BY conv_id
"""

EXACT = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS p
  FROM documents),
ranked AS (
  SELECT doc_id, p, first_value(doc_id) OVER (PARTITION BY p ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY p) AS group_size FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(p) AS text_sha256 FROM ranked
"""

# bytes as pairs of hex digits; taken from pieces of a text, as places far inside long strings are slow
SUFFIXES = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT r, doc_id, k, substring(h, 2000 * k + 1, 2198) AS g
  FROM (SELECT *, unnest(range(0, (len(h) // 2 + 900) // 1000)) AS k FROM docs WHERE doc_id IS NOT NULL AND len(h) >= 200)),
strings AS (
  SELECT r, doc_id, 1000 * k + j AS i, md5(substring(g, 2 * j + 1, 200)) AS s
  FROM (SELECT *, unnest(range(0, len(g) // 2 - 99)) AS j FROM pieces)),
firsts AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM strings GROUP BY s HAVING count(*) > 1),
later AS (SELECT r, i FROM strings JOIN firsts USING (s) WHERE struct_pack(d := doc_id, i := i) > f),
spans AS (
  SELECT r, min(i) AS low, max(i) + 100 AS high
  FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY r, run),
cuts AS (
  SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS last,
    string_agg(substring(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept
  FROM (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM spans) JOIN docs USING (r)
  GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cuts USING (r)
"""

# crc32 by bits: an entry of the list for each bit of the number's digits, lowest first
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: list_transform(range(0, 8), lambda k: (ascii(c) >> k::INTEGER) & 1)))),
  lambda s, b: xor(s >> 1, (xor(s, b) & 1) * 3988292384)))"""
PREFIXES = f"""
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS words, turn, coalesce(role, '') AS role
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, t, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) - 1 AS i FROM turns),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 20 AS head_id, {_CRC.replace('conv_id', 'c.conv_id')} % 4 AS h, coalesce(s.n, 0) AS head_n
  FROM sizes c LEFT JOIN sizes s ON s.conv_id = c.conv_id - c.conv_id % 20),
rebuilt AS (
  SELECT c.conv_id, i - h + least(h, head_n) + 1 AS d, t, words FROM placed p JOIN convs c ON p.conv_id = c.conv_id AND i >= h
  UNION ALL
  SELECT c.conv_id, i + 1, t, words FROM placed p JOIN convs c ON p.conv_id = c.head_id AND i < h),
ways AS (
  SELECT conv_id, d, words, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS way, max(d) OVER (PARTITION BY conv_id) AS n
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', coalesce(n, 0) FROM convs LEFT JOIN (SELECT conv_id, max(d) AS n FROM rebuilt GROUP BY 1) USING (conv_id)),
nodes AS (
  SELECT way, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS spared,
    count(*) FILTER (d = n) AS n_ends,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM ways GROUP BY way, d),
below AS (
  SELECT way, sum(spared) AS saved, count(*) FILTER (n_convs = n_ends) AS leaves
  FROM (SELECT left(way, 32 * unnest(range(0, d + 1))) AS way, spared, n_convs, n_ends FROM nodes) GROUP BY way),
children AS (SELECT left(way, 32 * (d - 1)) AS way, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below USING (way) LEFT JOIN children c USING (way)
LEFT JOIN nodes p ON x.d > 0 AND p.way = left(x.way, 32 * (x.d - 1))
"""

ORACLES: dict[str, str] = {
    "op2_jaccard": JACCARD,
    "op3_substrings": SUBSTRINGS,
    "op4_mixing": MIXING,
    "op6_decontaminate": DECONTAMINATE,
    "op9_chat": CHAT,
    "op10_exact": EXACT,
    "op12_suffixes": SUFFIXES,
    "op13_prefixes": PREFIXES,
}
