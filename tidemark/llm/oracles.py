"""DuckDB SQL for queries whose operators don't carry their own."""

from __future__ import annotations

from tidemark.llm.urlfilter import BIN, ORDER, PRIOR, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def mixing(seed: int = 7) -> str:
    """Exponents by plain bisection, then permutations of shards by the same hashes."""
    hashed = "('0x' || md5({})[1:15])::BIGINT"

    def bisect(name: str, holds: str) -> str:
        z, s = "sum(exp((low + high) / 2 * ln(share)))", "sum(exp((low + high) / 2 * ln(share)) * ln(share))"
        test = holds.format(a="(low + high) / 2", z=z, s=s, most="max(exp(((low + high) / 2 - 1) * ln(share)))")
        return f"{name} AS (SELECT 0 AS step, 0::DOUBLE AS low, 1::DOUBLE AS high UNION ALL SELECT step + 1, CASE WHEN {test} THEN (low + high) / 2 ELSE low END, CASE WHEN {test} THEN high ELSE (low + high) / 2 END FROM {name}, h WHERE step < 45 GROUP BY step, low, high)"

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY source HAVING sum(n) > 0),
h AS (SELECT *, tokens / (SELECT sum(tokens) FROM t) AS share, greatest(ln((SELECT count(*) FROM t)), 1e-300) AS full FROM t),
{bisect("e", "(ln({z}) - {a} * {s} / {z}) / any_value(h.full) >= 0.98")},
{bisect("r", "{most} / {z} > 4")},
a AS (SELECT least(1, greatest(CASE WHEN (SELECT -sum(share * ln(share)) / any_value(h.full) >= 0.98 FROM h) THEN 1 ELSE (SELECT max(low) FROM e) END,
  CASE WHEN (SELECT max(1 / share) / count(*) <= 4 FROM h) THEN 0 ELSE (SELECT max(low) FROM r) END)) AS a),
w AS (SELECT source AS of, round(pow(share, a) / (SELECT sum(pow(share, a)) FROM h, a) * (SELECT sum(tokens)::DOUBLE FROM t) / tokens, 6) AS passes, greatest(ceil(tokens / {1 << 18}), ceil(docs / {1 << 16}))::BIGINT AS shards, greatest(1, round((SELECT sum(tokens) FROM t) / {1 << 20}))::BIGINT AS blocks FROM h, a),
k AS (SELECT *, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS name FROM d JOIN w ON source IS NOT DISTINCT FROM of),
x AS (SELECT *, {hashed.format(f"'{seed}:' || name")} % shards AS shard, unnest(range(greatest(ceil(passes)::INT, 1)))::INT AS epoch FROM k),
o AS (SELECT *, {hashed.format(f"'{seed + 1}:' || epoch || ':' || name")} AS order_key FROM x),
p AS (SELECT *, epoch + (sum(n) OVER (PARTITION BY of, shard, epoch ORDER BY order_key, doc_id NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) - n / 2) / greatest(sum(n) OVER (PARTITION BY of, shard, epoch), 1) AS place FROM o)
SELECT doc_id, source, n AS n_tokens, epoch, least(floor(place / passes * blocks)::BIGINT, blocks - 1) AS block, order_key FROM p WHERE place < passes
"""


def ngram_join(n: int, num: int, den: int) -> str:
    """All pairs that share a shingle, counted, and the reach of every document by links."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN k kx ON kx.doc_id = x JOIN k ky ON ky.doc_id = y WHERE {den} * c >= {num} * (kx.n + ky.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON r.doc_id = e.x)
SELECT doc_id, coalesce(any_value(k.n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN k USING (doc_id) GROUP BY doc_id
"""


def url_filter() -> str:
    """The rules, and the same recursion over contexts as tables."""
    rules = "NULL"
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        rules = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{verdict} {host}{path}' ELSE {rules} END"
    levels = ["t0 AS (SELECT right(g, 1) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1), z AS (SELECT count(*) AS n, sum(a) AS a, sum(r) AS r FROM t0), p0 AS (SELECT g, (t0.a + 1) / (z.a + z.n + 1)::DOUBLE AS pa, (t0.r + 1) / (z.r + z.n + 1)::DOUBLE AS pr FROM t0, z)"]
    for k in range(1, ORDER + 1):
        levels.append(
            f"t{k} AS (SELECT right(g, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1), h{k} AS (SELECT left(g, {k}) AS h, sum(a) AS a, sum(r) AS r FROM t{k} GROUP BY 1),"
            f"p{k} AS (SELECT t{k}.g, (t{k}.a + {PRIOR} * q.pa) / (h{k}.a + {PRIOR}) AS pa, (t{k}.r + {PRIOR} * q.pr) / (h{k}.r + {PRIOR}) AS pr FROM t{k} JOIN h{k} ON left(t{k}.g, {k}) = h JOIN p{k - 1} q ON right(t{k}.g, {k}) = q.g)"
        )
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
b AS (SELECT *, split_part({rules}, ' ', 1) AS v, nullif(split_part({rules}, ' ', 2), '') AS rule, page_id % 5 = 0 AS held, repeat(chr(2), {ORDER}) || regexp_replace({_LOWER.format("url")}, '^https?://', '') || chr(3) AS s FROM u),
x AS (SELECT page_id, v, rule, held, substring(s, i::INT, {ORDER + 1}) AS g FROM (SELECT *, unnest(range(1, length(s) - {ORDER} + 1)) AS i FROM b)),
c AS (SELECT g, count(*) FILTER (v = 'allow' AND NOT held) AS a, count(*) FILTER (v = 'block' AND NOT held) AS r FROM x GROUP BY g),
{", ".join(levels)},
s AS (SELECT page_id, any_value(v) AS v, any_value(rule) AS rule, round(sum(ln(pa) - ln(pr)) / count(*), 9) AS score FROM x JOIN p{ORDER} ON x.g = p{ORDER}.g WHERE rule IS NULL OR held GROUP BY page_id),
n AS (SELECT greatest(-1000, least(1000, floor(score / {BIN})))::INT AS bin, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS r FROM s WHERE rule IS NOT NULL GROUP BY 1),
f AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin - 1) AS last, coalesce(sum(a) OVER o, 0) / nullif(sum(a) OVER (), 0) + (sum(r) OVER () - coalesce(sum(r) OVER o, 0)) / nullif(sum(r) OVER (), 0) AS error FROM n WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT (last + 1 + bin) / 2 * {BIN} FROM f WHERE error IS NOT NULL ORDER BY round(error, 11), bin LIMIT 1), 0) AS cut)
SELECT b.page_id, b.host, b.path, b.rule, CASE WHEN b.rule IS NOT NULL THEN b.v WHEN s.score >= cut THEN 'allow' ELSE 'block' END AS verdict FROM b LEFT JOIN s ON b.page_id = s.page_id, t
"""

_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
QUOTES = rf"""
WITH m AS (SELECT row_number() OVER () AS id, * FROM conversations),
l AS (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m WHERE text IS NOT NULL),
x AS (SELECT id, i, line, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS lv, regexp_replace(line, '^[ \t]*((?:>[ \t]?)*)', '') AS words FROM l),
y AS (SELECT *, CASE WHEN lv = 0 AND trim(words) = '' THEN -1 ELSE lv END AS pl FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT *, CASE WHEN lag(pl) OVER (PARTITION BY id ORDER BY i) IS DISTINCT FROM pl THEN 1 ELSE 0 END AS new FROM y)),
p AS (SELECT id, g, any_value(pl) AS pl, string_agg(words, chr(10) ORDER BY i) AS txt, count(*) FILTER (trim(words) <> '') AS n FROM z GROUP BY id, g),
q AS (SELECT DISTINCT id, pl, {_NORM.format("txt")} AS h, n FROM p WHERE pl > 0),
r AS (SELECT id, words, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM (SELECT id, i, {_NORM.format("words")} AS words FROM x WHERE lv = 0) WHERE words <> ''),
c AS (SELECT DISTINCT conv_id, n FROM q JOIN m USING (id) WHERE n > 1),
h AS (SELECT a.id, string_agg(b.words, ' ' ORDER BY b.i) AS h FROM r a JOIN m ON m.id = a.id JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id JOIN r b ON b.id = a.id AND b.i BETWEEN a.i AND a.i + c.n - 1 GROUP BY a.id, a.i, c.n HAVING count(*) = c.n UNION SELECT id, {_NORM.format("string_agg(words, chr(10) ORDER BY i)")} AS h FROM x WHERE lv = 0 GROUP BY id UNION SELECT id, {_NORM.format("txt")} FROM p WHERE pl = 0 UNION SELECT id, {_NORM.format("words")} FROM x WHERE lv = 0),
a AS (SELECT q.id, first(s.turn ORDER BY q.pl, s.turn DESC) AS quoted FROM q JOIN m ON m.id = q.id JOIN h ON h.h = q.h JOIN m s ON s.id = h.id AND s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.turn < m.turn WHERE q.h <> '' GROUP BY q.id),
n AS (SELECT id, count(*) FILTER (pl > 0) AS n_quoted, greatest(max(pl), 0) AS max_level FROM p GROUP BY id),
k AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lv = 0 AND NOT regexp_matches(line, '(?i)^[^\n]*\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$')), '') AS kept FROM x GROUP BY id),
o AS (SELECT id, row_number() OVER w AS position, lag(turn) OVER w AS previous FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, position, turn, role, CASE WHEN coalesce(max_level, 0) > 0 THEN trim(kept, ' ' || chr(9) || chr(10) || chr(13)) ELSE text END AS text, coalesce(quoted, previous) AS parent_turn,
  CASE WHEN quoted IS NOT NULL THEN 'quote' WHEN position > 1 THEN 'order' END AS link, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(max_level, 0)::INT AS max_level
FROM m JOIN o USING (id) LEFT JOIN n USING (id) LEFT JOIN k USING (id) LEFT JOIN a USING (id)
"""
