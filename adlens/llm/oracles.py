"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS ws FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS ws FROM benchmark),
  bw AS (SELECT DISTINCT item_id, l, md5(k) AS k FROM (SELECT item_id, least(13, len(ws)) AS l, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS k FROM b WHERE len(ws) > 0)),
  dw AS (SELECT doc_id, l, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: md5(array_to_string(ws[i:i + l - 1], ' ')))) AS k, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw)),
  m AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, k)),
  t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM m)),
  r AS (SELECT t.doc_id, t.i, max(e) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS e FROM t LEFT JOIN (SELECT doc_id, i, max(i + l) AS e FROM m GROUP BY ALL) s ON s.doc_id = t.doc_id AND s.i = t.i),
  h AS (SELECT doc_id, count(*) FILTER (e > i) AS n_hit FROM r GROUP BY 1),
  n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
  x AS (SELECT doc_id, ws, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS ks FROM w),
  s AS (SELECT doc_id, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM x),
  f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY 1),
  g AS (SELECT doc_id, i FROM s JOIN f USING (k) WHERE first < doc_id),
  t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
  c AS (SELECT t.doc_id, t.i, word, count(g.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS 49 PRECEDING) > 0 AS gone FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i),
  a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)"""

COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS ws FROM documents),
  g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS gs FROM w WHERE len(ws) > 0),
  s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM g),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
  r AS (SELECT DISTINCT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
  c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(gs), 0) AS BIGINT) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN g USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""


COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
  t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
  s AS (SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g FROM w, range(1, 6) r(m) WHERE len(ws) >= m),
  f AS (SELECT lang, g, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
  c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
  k AS (SELECT c.lang, c.g, c.a, cut, l.f AS l, r.f AS r, t.n, 1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f) AS score
    FROM c JOIN t USING (lang), range(1, 5) x(cut), f l, f r WHERE cut < len(c.g) AND l.lang = c.lang AND l.g = c.g[:cut] AND r.lang = c.lang AND r.g = c.g[cut + 1:]),
  b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
  q AS (SELECT lang, g[x:y] AS g, max(a) AS longer FROM c, range(1, 6) u(x), range(1, 6) v(y) WHERE x < y AND y <= len(g) AND y - x + 1 < len(g) GROUP BY ALL),
  z AS (SELECT b.* FROM b LEFT JOIN q USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z QUALIFY rank <= 2000"""


def conversations() -> str:
    """A recursion from each conversation's last row to its first carries, for each state, the least of cost, audit and repaired text as one string.

    Costs have ten digits; the audit ends at a character 1. Null stands for no way. crc32 is worked out byte by byte.
    """

    def after(x: str, cost: str, label: str, piece: str = "''") -> str:
        return f"lpad(CAST(CAST({x}[:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{label}' || {x}[11:strpos({x}, chr(1))] || {piece} || {x}[strpos({x}, chr(1)) + 1:]"

    def row(state: str) -> str:
        to = "xa" if state == "xu" else "xu"
        role = "assistant" if state == "xu" else "user"
        keep = {"x0": {"s": "xs", "u": "xu"}, "xs": {"u": "xu"}, "xu": {"a": "xa"}, "xa": {"u": "xu"}}[state]
        kept = " ".join(f"WHEN '{c}' THEN {after(x, 'extra', 'K', 'chr(10) || role || chr(58) || text')}" for c, x in keep.items())
        free = f"CASE WHEN NOT must THEN least({after(to, '3 + extra', 'R', f"chr(10) || '{role}:' || text")}, CASE initial {kept} END) END"
        return f"least({after(state, '4', 'D')}, {free})"

    def insert(x: str, role: str) -> str:
        return after(x, "3", "I", f"chr(10) || '{role}:'")

    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1])), 4294967295) % 20"
    return rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
  base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
  marked AS (SELECT *, {crc} AS k FROM base, tab),
  damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM marked, range(2) copies(i) WHERE k <> 0 AND (i = 0 OR k = 3)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged),
  placed AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS short, lag(substr(role, 1, 1)) OVER o AS before FROM ordered WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
  facts AS (SELECT *, blank OR again AS must, CASE WHEN short AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM placed),
  counts AS (SELECT conv_id, count(*) AS rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra > 0) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM facts GROUP BY 1),
  walk AS (
    SELECT conv_id, rows + 1 AS p, '0000000000' || chr(1) AS x0, '0000000006II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS xs, '0000000003I' || chr(1) || chr(10) || 'assistant:' AS xu, '0000000000' || chr(1) AS xa FROM counts
    UNION ALL
    SELECT conv_id, p, least(x0, {insert("nu", "user")}), least(xs, {insert("nu", "user")}), nu, least(xa, {insert("nu", "user")}) FROM (
      SELECT *, least(xu, {insert("xa", "assistant")}) AS nu FROM (
        SELECT w.conv_id, f.p, {row("x0")} AS x0, {row("xs")} AS xs, {row("xu")} AS xu, {row("xa")} AS xa FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p - 1))),
  found AS (SELECT conv_id, x0 FROM walk WHERE p = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(x0[:10] AS BIGINT), 0) AS cost, coalesce(x0[11:strpos(x0, chr(1)) - 1], '') AS audit, sha256(coalesce(x0[strpos(x0, chr(1)) + 2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _shrunk(child: str, parent: str, key: str, up: str) -> str:
    name = f"s_{key}"
    return f"""
  j_{key} AS (SELECT c.*, p.rate AS prior FROM {child} c JOIN {parent} p USING ({up})),
  v_{key} AS (SELECT {up}, sum(n) AS n_all, count(*) AS k, sum(n * pow(bad / n - prior, 2)) AS ss FROM j_{key} GROUP BY 1),
  t_{key} AS (SELECT j.*, CASE WHEN prior * (1 - prior) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, (prior * (1 - prior) - ss / n_all) / greatest(ss / n_all - prior * (1 - prior) / (n_all / k), 1e-9))) END AS w FROM j_{key} j JOIN v_{key} USING ({up})),
  q_{key} AS (SELECT *, bad + w * prior AS al, n - bad + w * (1 - prior) AS be FROM t_{key}),
  {name} AS (SELECT *, al / (al + be) AS rate, greatest(0.0, al / (al + be) - 1.645 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1)))) AS lower FROM q_{key})"""


def url_filter(rules, suffixes) -> str:
    whens = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)
    )
    blocks = ", ".join(f"'{h}{p}'" for v, h, p in rules if v == "block")
    two = ", ".join(f"'{x}'" for x in suffixes)
    last = lambda k: f"array_to_string(labels[-{k}:], '.')"
    address = r"regexp_matches(bare, '^(\[.*\]|\d+(\.\d+){3})\z')"
    levels = f"""CASE WHEN {address} THEN bare WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
    CASE WHEN {address} THEN bare WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE labels[-1] END AS suffix"""
    bare = r"regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':\d*\z', ''), '\.+\z', '')"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  p AS (SELECT *, CASE {whens} END AS rule, {bare} AS bare, string_split(bare, '.') AS labels FROM u),
  host AS (SELECT host, {levels}, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (rule IN ({blocks})) AS DOUBLE) AS bad FROM p WHERE rule IS NOT NULL GROUP BY host, bare, labels),
  domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host GROUP BY ALL),
  suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, '' AS corpus FROM domain GROUP BY suffix),
  corpus AS (SELECT corpus, (sum(bad) + 1) / (sum(n) + 2) AS rate FROM suffix GROUP BY 1),{_shrunk("suffix", "corpus", "suffix", "corpus")},{_shrunk("domain", "s_suffix", "domain", "suffix")},{_shrunk("(SELECT host, domain, n, bad FROM host)", "s_domain", "host", "domain")},
  a AS (SELECT page_id, host, path, rule, {levels} FROM p)
SELECT page_id, a.host, path, rule, CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN a.host <> '' AND coalesce(h.lower, d.lower, s.lower, 0) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM a LEFT JOIN s_host h ON h.host = a.host LEFT JOIN s_domain d ON d.domain = a.domain LEFT JOIN s_suffix s ON s.suffix = a.suffix"""
