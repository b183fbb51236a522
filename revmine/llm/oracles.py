"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept
FROM b"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, item_id, i, o.size FROM occ o JOIN win USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op4_proximity(span: int) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_distinct(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}')) AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, w, unnest(w) AS word FROM b),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
whole AS (SELECT doc_id, item_id, iw.w FROM (SELECT DISTINCT doc_id, word FROM pos) JOIN iw USING (word)
          GROUP BY ALL HAVING count(*) = len(iw.w)),
occ AS (
  SELECT doc_id, item_id, w, count(DISTINCT word) OVER (PARTITION BY doc_id, item_id, w ORDER BY i RANGE BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) AS n
  FROM whole JOIN iw USING (item_id, w) JOIN pos USING (doc_id, word)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM occ WHERE n = len(w) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near_items, 0)::BIGINT AS n_near_items FROM d LEFT JOIN near USING (doc_id)"""


OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp ON node = doc_id LEFT JOIN n USING (doc_id)"""


def op6(probe: str) -> str:
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
s AS (
  SELECT *, length(role) + length(text) + 11
         + 4 * length(regexp_replace(role || text, '[^&]', '', 'g')) + 3 * length(regexp_replace(role || text, '[^<>]', '', 'g')) AS n FROM t),
o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted,
         coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS expanded
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted::BIGINT AS formatted_chars, expanded::BIGINT AS example_chars
FROM c"""


def op7(templates: dict[str, list[str]]) -> str:
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, texts in templates.items() for t in texts)
    words = f"regexp_extract_all({_LOWERED.format('coalesce(text, chr(32))')}, '{ALNUM}')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT row_number() OVER () AS t, name, {words} AS w FROM (VALUES {rows}) v(name, text)),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
ts AS (SELECT DISTINCT t, name, CAST(pow(2, ceil(log2(greatest(len(w) - 4, 1)))) AS BIGINT) AS step, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT t, name, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT t, count(*) AS n FROM ts GROUP BY t),
hit AS (SELECT doc_id, t, name, step, p // step AS block, s FROM ds JOIN ts USING (s)),
win AS (SELECT doc_id, t, name, step, unnest([block - 1, block]) AS k, s FROM hit),
found AS (SELECT doc_id, t, name, k * step AS pos, k * step + 2 * step AS till, n.n AS n, count(DISTINCT s) AS f, list(DISTINCT s) AS fs
          FROM win JOIN n USING (t) WHERE k >= 0 GROUP BY doc_id, t, name, k, step, n.n HAVING 100 * count(DISTINCT s) >= 75 * n.n),
tl AS (SELECT t, list(s) AS all_s FROM ts GROUP BY t),
m AS (SELECT doc_id, name, min(pos) AS pos FROM found x WHERE NOT EXISTS (
        SELECT 1 FROM found o JOIN tl ON tl.t = o.t WHERE o.doc_id = x.doc_id AND o.name <> x.name AND o.pos < x.till AND x.pos < o.till AND o.f * x.n > x.f * o.n
          AND 100 * len(list_intersect(x.fs, all_s)) >= 75 * x.f)
      GROUP BY doc_id, name),
g AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses, string_agg(pos::VARCHAR, ',' ORDER BY name) AS first_windows
      FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(first_windows, '') AS first_windows
FROM d LEFT JOIN g USING (doc_id)"""


def op10(rules: list[tuple[str, str]], blocked: list[str]) -> str:
    rows = ", ".join(f"('{e}', '{e[:e.index('/')]}', '{e[e.index('/'):]}', '{v}')" for e, v in rules)
    hosts = ", ".join(f"('{h}')" for h in blocked)
    return f"""
WITH p AS (
  SELECT page_id, {_LOWERED.format("coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, rule_host, rule_path, rule_verdict) AS (VALUES {rows}),
listed(name) AS (VALUES {hosts}),
hit AS (SELECT DISTINCT host, path, rule, rule_verdict FROM p JOIN r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM hit GROUP BY host, path)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN host = '' OR EXISTS (SELECT 1 FROM listed WHERE host = name OR ends_with(host, '.' || name)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (host, path)"""


def op11(n_buckets: int) -> str:
    """CRC-32 from its polynomial, byte by byte, over each distinct feature."""
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS v, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tbl AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d WHERE len(w) > 1),
bf AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b WHERE len(w) > 1),
dc AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY ALL),
bc AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
seen AS (SELECT f, hex(encode(f)) AS h FROM dc UNION SELECT f, hex(encode(f)) FROM bc),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {n_buckets} AS bucket
  FROM seen, tbl),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dc JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bc JOIN hashed USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {n_buckets}) / ((coalesce(s, 0) + 1) * (tt + {n_buckets}))))::BIGINT AS g
         FROM s FULL JOIN t USING (bucket), tot),
mean AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::BIGINT / sum(n)::BIGINT)::BIGINT AS weight
         FROM dc JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN mean USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


def op12(scan) -> str:
    """Places of a pattern's matches: what lies between them and they themselves, added up."""
    def parts(i: int, k) -> str:
        pattern = k.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{pattern}', {k.group})"
        mixed = " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if k.mixed else ""
        return rf"""
SELECT doc_id, {i} AS kind, '{k.name}' AS name, '{k.role}' AS role, b, b + length(m) AS e FROM (
  SELECT doc_id, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS b
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')))
WHERE length({value}) >= {k.least}{mixed}"""
    base = len(scan.BASE)
    near = "q.doc_id = c.doc_id AND q.scope = c.scope AND q.b < c.e + {0} AND q.e > c.b - {0}".format(scan.REACH)
    has = lambda role: f"EXISTS (SELECT 1 FROM mine q WHERE {near} AND q.role = '{role}')"
    counts = ", ".join(f"count(*) FILTER (name = '{k.name}')::BIGINT AS n_{k.name}" for k in scan.BASE)
    written = "name || ':' || b || ':' || e, ',' ORDER BY b, kind"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts(i, k) for i, k in enumerate(scan.KINDS))}),
mine AS (
  SELECT c.*, (SELECT len(regexp_extract_all(substr(text, 1, c.b::BIGINT), '{scan.BLANK_LINE}')) FROM d WHERE d.doc_id = c.doc_id) AS scope FROM found c
  WHERE kind < {base} OR NOT EXISTS (SELECT 1 FROM found q WHERE q.doc_id = c.doc_id AND q.kind < c.kind AND q.b < c.e AND q.e > c.b)),
reported AS (
  SELECT * FROM mine c WHERE kind < {base} OR (role = 'identifier' AND {has("secret")}) OR (role = 'secret' AND {has("identifier")})
    OR (role = 'endpoint' AND {has("identifier")} AND {has("secret")})),
one AS (SELECT doc_id, {counts}, string_agg({written}) FILTER (kind < {base}) AS base, string_agg({written}) AS spans,
               count(*) FILTER (kind >= {base})::BIGINT AS n_linked FROM reported GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked FROM d LEFT JOIN one USING (doc_id)"""
