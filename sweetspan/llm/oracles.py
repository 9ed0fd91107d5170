"""DuckDB SQL of the queries in ``registry`` that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

URLS = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lin AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lin.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lin ON d.doc_id = lin.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM b GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mu, CAST(count(*) AS DOUBLE) / sum(n) AS hn, sum(f * f / n) / sum(n) AS ff FROM h),
v AS (SELECT mu, greatest(ff - mu * mu, 0) AS s, mu * (1 - mu) * hn AS e FROM t),
w AS (SELECT mu, CASE WHEN s > e THEN least(greatest((mu * (1 - mu) - s) / (s - e), 1), 1e9) ELSE 1e9 END AS weight FROM v),
r AS (SELECT source, (f + mu * weight) / (n + weight) AS rate, n + weight AS size, 4 * mu / (1 - mu + 4 * mu) AS top FROM h, w)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(rate, 6) AS host_rate, NOT base_failed AND rate - 1.645e0 * sqrt(rate * (1 - rate) / (size + 1)) <= top AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight FROM s),
c AS (
  SELECT *, 1.5e0 * sum(source_size) OVER () AS budget,
    (1.5e0 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM k WINDOW before AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, budget,
    least(2e0 * source_size, coalesce(max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER () * weight, 2e0 * source_size)) AS target
  FROM c),
r AS (
  SELECT d.doc_id, d.source, size, source_size, target, budget, key,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT doc_id, size, key, copy, budget, CAST(run + copy * source_size AS DOUBLE) / target AS finish FROM r, (SELECT unnest([0, 1]) AS copy) WHERE size > 0),
g AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS total FROM f),
u AS (SELECT doc_id, sum(size) AS taken FROM g WHERE total <= budget GROUP BY doc_id)
SELECT r.doc_id, size, source_size, round(target, 4) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM r LEFT JOIN u ON r.doc_id = u.doc_id
"""



def _majority(name: str, members: str, by: str) -> str:
    """The members (by, own, w) that agree with the words most of their group have, if these are enough; ``by`` begins with leaf."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    of = lambda a: ", ".join(f"{a}.{c}" for c in by.split(", "))
    return f"""
{name}_s AS (SELECT {by}, count(*) AS members, min(len(w)) AS n FROM {members} GROUP BY {by} HAVING count(*) > 1),
{name}_p AS (SELECT {of("m")}, m.own, s.members, s.n, unnest(range(4, len(w) + 1)) AS q, unnest(w[4:]) AS x FROM {members} m JOIN {name}_s s ON {on("m", "s")}),
{name}_k AS (SELECT {by}, q, x, any_value(n) AS n FROM {name}_p GROUP BY {by}, q, x, members HAVING 2 * count(*) > members),
{name}_t AS (SELECT {by}, count(*) AS k, string_agg((q - 1) || ' ' || x, ' ' ORDER BY q) AS name FROM {name}_k GROUP BY {by} HAVING count(*) >= 0.5 * (any_value(n) - 3)),
{name}_a AS (SELECT {of("p")}, p.own, count(*) AS same FROM {name}_p p JOIN {name}_k k ON {on("p", "k")} AND p.q = k.q AND p.x = k.x GROUP BY {of("p")}, p.own),
{name} AS (SELECT DISTINCT a.leaf, a.own, t.k, t.name FROM {name}_a a JOIN {name}_t t ON {on("a", "t")} WHERE a.same >= 0.8 * t.k)"""


#: Lines and leaves of several variants; the leaf's majority; families of the rest by their rarest shared words; what recurs.
LINES = rf"""
WITH l AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, pos, array_to_string(raw, ' ') AS raw, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l WHERE len(raw) > 0),
k AS (SELECT doc_id, pos, raw, w, len(w) AS n, array_to_string(w, ' ') AS own, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM w),
e AS (SELECT leaf FROM k GROUP BY leaf HAVING min(doc_id) <> max(doc_id) AND count(*) >= CASE WHEN min(n) >= 50 THEN 2 WHEN min(n) < 3 THEN 10 ELSE 3 END),
fnd AS (SELECT k.* FROM k JOIN e ON k.leaf = e.leaf),
var AS (SELECT leaf, own, any_value(w) AS w FROM fnd GROUP BY leaf, own),
v AS (SELECT * FROM var WHERE len(w) > 3 AND leaf IN (SELECT leaf FROM var GROUP BY leaf HAVING count(*) > 1)),
{_majority("most", "v", "leaf")},
rest AS (SELECT v.* FROM v ANTI JOIN most ON v.leaf = most.leaf AND v.own = most.own),
pl AS (SELECT leaf, own, CAST(ceil(0.5 * (len(w) - 3)) AS INT) AS half, unnest(range(4, len(w) + 1)) AS p, unnest(w[4:]) AS word FROM rest),
cn AS (SELECT leaf, p, word, count(*) AS c FROM pl GROUP BY leaf, p, word HAVING count(*) > 1),
sh AS (SELECT pl.leaf, own, any_value(half) AS half, list({{'c': c, 'p': pl.p, 'word': pl.word}} ORDER BY c, pl.p, pl.word) AS shared FROM pl JOIN cn ON pl.leaf = cn.leaf AND pl.p = cn.p AND pl.word = cn.word GROUP BY pl.leaf, own),
pv AS (SELECT leaf, own, unnest(list_filter(shared, lambda y: y.c >= shared[len(shared) - half + 1].c)[1:3]) AS y FROM sh WHERE len(shared) >= half),
mem AS (SELECT pv.leaf, pv.y.p AS p, pv.y.word AS word, rest.own, rest.w FROM pv JOIN rest ON pv.leaf = rest.leaf AND pv.own = rest.own),
{_majority("fam", "mem", "leaf, p, word")},
fs AS (SELECT leaf, name, count(*) AS v FROM fam GROUP BY leaf, name),
best AS (SELECT leaf, own, name FROM (SELECT fam.*, row_number() OVER (PARTITION BY fam.leaf, own ORDER BY v DESC, k DESC, fam.name DESC) AS r FROM fam JOIN fs ON fam.leaf = fs.leaf AND fam.name = fs.name) WHERE r = 1),
fits AS (SELECT leaf, own, name FROM most UNION ALL SELECT leaf, own, name FROM best),
lines AS (SELECT fnd.doc_id, pos, n, CASE WHEN n >= 50 THEN raw END AS raw, CASE WHEN name IS NOT NULL THEN 't' || fnd.leaf || chr(10) || name ELSE 'o' || fnd.own END AS template FROM fnd LEFT JOIN fits ON fnd.leaf = fits.leaf AND fnd.own = fits.own),
rec AS (SELECT template, min(doc_id) AS head FROM lines GROUP BY template HAVING count(DISTINCT doc_id) >= CASE WHEN min(n) < 3 THEN 10 ELSE 3 END),
quo AS (SELECT raw, min(doc_id) AS head FROM lines WHERE raw IS NOT NULL GROUP BY raw HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT doc_id, pos, bool_or(sure) AS sure FROM (
  SELECT doc_id, pos, true AS sure FROM lines JOIN rec ON lines.template = rec.template WHERE doc_id <> head
  UNION ALL SELECT doc_id, pos, false FROM lines JOIN quo ON lines.raw = quo.raw WHERE doc_id <> head) GROUP BY doc_id, pos),
j AS (SELECT l.doc_id, l.pos, line, len(raw) > 0 AS wordy, gone.pos IS NOT NULL AS dropped, coalesce(sure, false) AS sure FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos),
d AS (SELECT doc_id, bool_or(wordy AND NOT dropped) AS some_left FROM j GROUP BY doc_id),
f AS (SELECT j.doc_id, pos, line, CASE WHEN some_left THEN dropped ELSE sure END AS dropped FROM j JOIN d ON j.doc_id = d.doc_id),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE dropped) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS text FROM f GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN x.text IS NOT NULL THEN md5(coalesce(r.text, '')) END AS text_md5
FROM documents x LEFT JOIN r ON x.doc_id = r.doc_id
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
t AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
q AS MATERIALIZED (SELECT item_id, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, s GROUP BY term, nd),
i AS (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS impact FROM t JOIN w ON t.term = w.term JOIN n ON t.doc_id = n.doc_id, s),
x AS (SELECT item_id, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM q JOIN i ON q.term = i.term GROUP BY item_id, doc_id HAVING sum(c * impact) > 0),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds over integers, unrolled."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for r in range(rounds + 1):
        parts.append(f"m{r} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min({distance} * {k} + y.c) AS m FROM kept x, c{r} y GROUP BY vec_id)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, CAST(m % {k} AS INT) AS cluster, CAST(m // {k} AS BIGINT) AS distance FROM m{r})")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, i, sum(f) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS f, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)")
            parts.append(f"f{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN f{r} ON c = cluster)")
    last = f"SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = c"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = {"op2_url_filter": URLS, "op3_quality_rules": QUALITY, "op5_mixing": MIXING, "op8_line_templates": LINES, "op11_yinyang": _clusters(), "op13_impact_search": SEARCH}
