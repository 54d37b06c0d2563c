"""SQL twins that need some building."""

from __future__ import annotations

from . import url_filter
from .sharding import PRODUCTION

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')))) END AS g FROM d),
c AS (SELECT g, min(doc_id) AS least, row_number() OVER () AS c, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT c, n, unnest(g) AS x FROM c),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS k, a.n AS na, b.n AS nb FROM u a JOIN u b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2, 4, 5),
link AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT b, a FROM common WHERE 100 * k >= 80 * (na + nb - k)),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
named AS (SELECT reach.a AS c, min(c.least) AS component_id FROM reach JOIN c ON c.c = reach.b GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(named.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN named ON named.c = c.c
"""


def _crc32(bytes_of: str) -> str:
    """CRC-32 over a list of byte values, with the table made from its polynomial."""
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_of}), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295::UBIGINT)"


def op1_sql() -> str:
    """The draws of the production tree, level by level."""
    draw = "-ln((CAST('0x' || substr(md5({path} || ':' || k), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / {w}"
    parts, before = [], "docs"
    for n, children in enumerate(PRODUCTION.levels()):
        values = ", ".join(f"('{parent}', '{path}', {w}::DOUBLE, {number})" for parent, below in children.items() for path, w, number in below)
        parts.append(f"t{n}(parent, path, w, num) AS (VALUES {values})")
        best = "min(d)" if n == 0 else "any_value(best)"
        top = "" if n == 0 else ", best"
        parts.append(f"l{n} AS (SELECT r, any_value(k) AS k, arg_min(path, (d, path)) AS path, arg_min(num, (d, path)) AS num, {best} AS best FROM (SELECT r, k{top}, t{n}.path, t{n}.num, {draw.format(path=f't{n}.path', w='w')} AS d FROM {before} JOIN t{n} ON t{n}.parent = {before}.path) GROUP BY r)")
        before = f"l{n}"
    g = PRODUCTION.changes[0]
    grown = draw.format(path=f"'{g.region}/{g.rack}/+0'", w=f"{g.weight}::DOUBLE")
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, list_transform(range(8), lambda q: 0::UBIGINT)), lambda c, q: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))"
    as_bytes = "list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS UBIGINT))"
    return (
        f"WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, '' AS path FROM documents), crc AS (SELECT {table} AS tab), "
        + ", ".join(parts)
        + f", placed AS (SELECT docs.doc_id, CAST(len(h) // 2 + 16 AS BIGINT) AS size, CAST({_crc32(as_bytes)} AS BIGINT) AS text_crc32, CAST(num AS INTEGER) AS shard, CAST(CASE WHEN {grown.replace(' || k)', ' || l2.k)')} < best THEN 40 ELSE num END AS INTEGER) AS grown_shard FROM l2 JOIN docs ON l2.r = docs.r, crc) "
        "SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"
    )


def op12_sql() -> str:
    """Rules and classifier of the URL filter: n-grams, kernel matrix, gradient steps and scores."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def split(source: str, keep: str) -> str:
        rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
        host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{upper.lower()}'), '')"
        return f"SELECT {keep}, {host} AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM {source}"

    def grams(source: str, keep: str) -> str:
        parts = []
        for field, name in enumerate(("host", "path")):
            for n in url_filter.SIZES:
                code = "c[k]"
                for step in range(1, n):
                    code = f"({code}) * {url_filter.BASE} + coalesce(c[k + {step}], 0)"
                parts.append(
                    f"SELECT {keep}, unnest(list_transform(range(1, greatest(len(c) - {n - 1}, 1) + 1), lambda k: (({code}) * 4 + {2 * field + n % 2}) % {url_filter.BUCKETS})) AS bucket, 1 / sqrt(greatest(2 * len(c) - {sum(url_filter.SIZES) - 2}, 1)) AS v "
                    f"FROM (SELECT {keep}, list_transform(string_split('^' || {name} || '$', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM {source})"
                )
        return f"SELECT {keep}, bucket, sum(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY {keep}, bucket"

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    rows = ", ".join(map(str, url_filter.labelled_rows()))
    dot = "list_sum(list_transform(range(1, len(a) + 1), lambda j: m[i][j] * a[j]))"
    step = f"list_transform(range(1, len(a) + 1), lambda i: a[i] + rate * (ys[i] - 1 / (1 + exp(-{dot})) - {url_filter.DECAY} * a[i]))"
    return f"""
WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY url, y) AS i, * FROM (VALUES {rows}) AS t(url, y)),
ls AS ({split("l", "i, y")}),
x AS ({grams("ls", "i")} UNION ALL SELECT i, {url_filter.BUCKETS}, 1 FROM l),
k AS (SELECT p.i, q.i AS j, sum(p.v * q.v) AS k FROM x p JOIN x q ON p.bucket = q.bucket GROUP BY 1, 2),
lines AS (SELECT i, list(k ORDER BY j) AS line, sum(k) AS reach FROM k GROUP BY i),
whole AS MATERIALIZED (SELECT list(line ORDER BY i) AS m, list(CAST(y AS DOUBLE) ORDER BY i) AS ys, 4 / max(reach) AS rate FROM lines JOIN l USING (i)),
fit AS (SELECT 0 AS t, list_transform(ys, lambda y: 0::DOUBLE) AS a FROM whole
  UNION ALL SELECT t + 1, {step} FROM fit, whole WHERE t < {url_filter.STEPS}),
alpha AS (SELECT unnest(range(1, len(a) + 1)) AS i, unnest(a) AS a FROM fit WHERE t = {url_filter.STEPS}),
w AS (SELECT bucket, sum(a * v) AS w FROM x JOIN alpha USING (i) GROUP BY bucket),
p AS ({split("(SELECT row_number() OVER () AS r, page_id, url FROM pages)", "r, page_id")}),
g AS ({grams("p", "r")}),
s AS (SELECT r, coalesce(sum(v * w), 0) + (SELECT w FROM w WHERE bucket = {url_filter.BUCKETS}) AS odds FROM (SELECT r, bucket, v FROM g UNION ALL SELECT r, -1, 0 FROM p) LEFT JOIN w USING (bucket) GROUP BY r),
fits AS (SELECT r, arg_max(h || t, length(h || t)) AS rule, arg_max(v, length(h || t)) AS v
  FROM p JOIN (VALUES {rules}) AS rules(h, t, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(fits.v, CASE WHEN odds >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (r) LEFT JOIN s USING (r)
"""
