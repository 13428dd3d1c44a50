"""DuckDB SQL of the corpus operators."""

from .line_rules import (
    BOILERPLATE, MAX_LOST, MAX_REPEATED, MAX_SEPARATORS, MAX_SHOUTED, MAX_SYMBOLS, MIN_WORDS, SEPARATORS, SHORT_LINE,
)

WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"


def _quoted(items: tuple[bytes, ...]) -> str:
    return ", ".join(f"'{x.decode()}'" for x in items)


LINE_RULES_SQL = f"""
WITH lines AS (
  SELECT doc_id, l, i FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents)
  WHERE regexp_matches(l, '{WORD}')),
lw AS (SELECT *, {words('l')} AS w, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) > 1 AS dup FROM lines),
judged AS (
  SELECT doc_id, dup, len(w) AS n,
    dup
    OR 100 * len(regexp_extract_all(l, '{_SYMBOL}')) > {MAX_SYMBOLS} * list_sum(list_transform(w, lambda x: strlen(x)))
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '[!?][!?]+$'))) > {MAX_SHOUTED} * len(w)
    OR 100 * len(list_filter(w, lambda x: x IN ({_quoted(SEPARATORS)}))) > {MAX_SEPARATORS} * len(w)
    OR (len(w) <= {SHORT_LINE}
        AND len(list_filter([{_quoted(BOILERPLATE)}], lambda p: contains(lower(l), p))) > 0) AS bad
  FROM lw),
per AS (SELECT doc_id, sum(dup::INT) AS n_dup_lines, sum(bad::INT) AS n_bad_lines,
               sum(CASE WHEN bad THEN n ELSE 0 END) AS lost_words FROM judged GROUP BY 1),
base AS (SELECT doc_id, {words('text')} AS w, text FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 4),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY 1),
facts AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '{_SYMBOL}'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM base b LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
  AND 100 * lost_words <= {MAX_LOST} * n_words AS kept
FROM facts
"""


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, {words('text')} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
hits AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM wins) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN edges ON a = other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM documents JOIN reach ON node = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
          WHERE x.e IS NOT NULL AND y.e IS NOT NULL AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT node, b FROM reach JOIN edges ON a = other),
n AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM embeddings JOIN reach ON node = vec_id LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

_KEY = "A-Za-z0-9+/_=-"
_ASSIGN = f"""(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([{_KEY.replace('=-', '.=-')}]+)"""


def _found(kind: str, order: int, pattern: str, group: int, value_ok: str) -> str:
    """Matches of one pattern with their places: pieces between matches give the offsets."""
    return f"""
SELECT doc_id, source, '{kind}' AS kind, {order} AS o, start, start + length(m) AS stop, v FROM (
  SELECT doc_id, source, unnest(ms) AS m, unnest(vs) AS v,
    unnest(list_transform(range(1, len(ms) + 1), lambda i:
      coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS start
  FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
          string_split_regex(t, '{pattern}') AS ps FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)))
WHERE {value_ok}"""


_ENTROPY = """-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c:
  len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v))))"""

SECRETS_SQL = f"""
WITH base AS ({_found('assign', 0, _ASSIGN, 1, 'length(v) >= 6')}
  UNION ALL {_found('access', 1, 'AKIA[A-Z0-9]{16,}', 0, 'true')}
  UNION ALL {_found('hex', 2, '[0-9a-f]{24,}', 0, 'true')}),
more AS ({_found('owned', 3, f'[{_KEY}]{{20,}}', 0,
  f"regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND {_ENTROPY} >= 3.5")}),
free AS (SELECT * FROM more m WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)),
hits AS (SELECT * FROM base UNION ALL SELECT * FROM free),
facts AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM hits GROUP BY 1),
judged AS (SELECT *, owners <= 1 AS live FROM hits JOIN facts USING (v) WHERE kind <> 'owned' OR owners <= 1),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> 'owned') AS base
  FROM judged GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples
FROM documents LEFT JOIN per USING (doc_id)
"""

RESAMPLE_SQL = f"""
WITH bits AS (SELECT unnest(range(256)) AS b),
crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM bits),
raw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
aim AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
rf AS (SELECT f, count(*) AS n FROM (SELECT unnest(ws) AS f FROM raw) GROUP BY 1),
tf AS (SELECT f, count(*) AS n FROM (SELECT unnest(ws) AS f FROM aim) GROUP BY 1),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM rf UNION SELECT f FROM tf)),
bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS bs FROM hexed),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes CROSS JOIN crc_table),
held AS (
  SELECT bucket, coalesce(sum(rf.n), 0) AS s, coalesce(sum(tf.n), 0) AS t
  FROM hashed LEFT JOIN rf USING (f) LEFT JOIN tf USING (f) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM held),
per AS (
  SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM (SELECT doc_id, unnest(ws) AS f FROM raw) JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN per USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
    count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM ranked
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_SQL = f"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term
  FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
size AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN size GROUP BY term, nd),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term
  FROM benchmark WHERE text IS NOT NULL),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) CROSS JOIN size GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
