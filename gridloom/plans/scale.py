"""Queries of what works on one long run, one key, or pairs that are no equality: scans, order statistics, range and substring joins, wavefronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convergence as V
from ..functions import joins, scans, variants
from ..functions import statistics as S
from ..operators import boundary, quadtree, solvers, timestep, wavefront
from .analytics import BENCH, _table, bench, rounded
from .fields import FIELD, RUN_FIELD, G, g17, runs17, spectral, within

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


ONE = "OVER (ORDER BY ts, event_id)"


@query(
    "one_run_scans",
    f"SELECT event_id, min(value) {ONE} AS best, count(value) {ONE} AS seen, coalesce(epoch_us(ts) - lag(epoch_us(ts)) {ONE}, 0) AS gap, CAST(sum(CAST(value AS DECIMAL(18,2))) {ONE} AS DOUBLE) AS so_far, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) {ONE}, -1) AS last_error FROM events",
)
def one_run_scans(spark, sf_dir):
    """All events as one run: best so far, count, gap to the event before, running sum, the last error so far."""
    events = _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", F.col("value").cast("decimal(18,2)").alias("exact"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))
    out = scans.running(events, [], ["at", "event_id"], best=("min", "value"), seen=("count", "value"), before=("lag", "at"), so_far=("sum", "exact"), last_error=("last", "error"))
    return out.select("event_id", "best", "seen", F.coalesce(F.col("at") - F.col("before"), F.lit(0)).alias("gap"), F.col("so_far").cast("double").alias("so_far"), F.coalesce("last_error", F.lit(-1)).alias("last_error"))


@query(
    "lru_evict_one_owner",
    "SELECT o_orderkey, CAST(before AS DOUBLE) AS freed_before FROM (SELECT o_orderkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
    "sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER () AS whole FROM orders) WHERE before < whole / 3",
)
def lru_evict_one_owner(spark, sf_dir):
    """All orders as one owner's entries: the oldest, until a third of the whole is freed."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    out = scans.running(orders, [], ["at", "o_orderkey"], before=("sum_before", "size"), whole=("total", "size"))
    return out.where(F.col("before") < F.col("whole") / 3).select("o_orderkey", F.col("before").cast("double").alias("freed_before"))


@query("order_statistics_one_key", "SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def order_statistics_one_key(spark, sf_dir):
    return rounded(scans.order_statistics(_table(spark, sf_dir, "lineitem"), [], "l_extendedprice", {"p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}), 6, "p5", "median", "p95", "p99")


@query("order_statistics", f"WITH {BENCH} SELECT solver, prec, round(quantile_cont(elapsed, 0.25), 6) AS q1, round(quantile_cont(elapsed, 0.5), 6) AS median, round(quantile_cont(elapsed, 0.95), 6) AS p95 FROM b GROUP BY ALL")
def order_statistics(spark, sf_dir):
    return rounded(scans.order_statistics(bench(spark, sf_dir), ["solver", "prec"], "elapsed", {"q1": 0.25, "median": 0.5, "p95": 0.95}), 6, "q1", "median", "p95")


@query(
    "range_join_first_match",
    "WITH s AS (SELECT o_orderkey, 1704067200 + o_orderkey * 173 % 2592000 AS low, CAST(floor(o_totalprice) AS BIGINT) % 1800 AS n FROM orders), e AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events) "
    "SELECT event_id, count(*) AS held_by, min(o_orderkey) AS first FROM e JOIN s ON sec >= low AND sec < low + n GROUP BY event_id",
)
def range_join_first_match(spark, sf_dir):
    """Events in intervals made of orders: how many hold each, and the first of them in the list."""
    low = F.lit(1704067200) + F.col("o_orderkey") * 173 % 2592000
    spans = _table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"), (low + F.floor("o_totalprice") % 1800).alias("high"))
    events = _table(spark, sf_dir, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"))
    found = joins.range_aggregate(events, "at", spans, "low", "high", held_by=("count", "low"), first=("min", "o_orderkey"))
    return found.groupBy("event_id").agg(F.sum("held_by").alias("held_by"), F.min("first").alias("first"))


@query(
    "substring_join",
    "WITH t AS (SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT DISTINCT lower(right(p_name, 3)) FROM part UNION SELECT DISTINCT lower(left(p_name, 2)) FROM part) "
    "SELECT term, count(*) AS names, min(p_partkey) AS first, max(p_partkey) AS last FROM part JOIN t ON contains(lower(p_name), term) GROUP BY term",
)
def substring_join(spark, sf_dir):
    """Part names that contain a term, for terms from the table itself, of two letters and more."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    terms = part.select(F.col("p_type").alias("term")).union(part.select(F.right("p_name", F.lit(3)))).union(part.select(F.left("p_name", F.lit(2))))
    found = joins.contains_join(part.select("p_partkey", "p_name"), "p_partkey", "p_name", terms, "term")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("names"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


#: Share of Student's t within (-t, t) for whole degrees v, by its finite sums.
WITHIN_T = (
    "(CASE WHEN v % 2 = 0 THEN {t} / sqrt(v + {t} * {t}) * list_sum(list_transform(range(v // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(v / (v + {t} * {t}), k))) "
    "ELSE 2 / pi() * (atan({t} / sqrt(v)) + {t} / sqrt(v + {t} * {t}) * sqrt(v / (v + {t} * {t})) * coalesce(list_sum(list_transform(range((v - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(v / (v + {t} * {t}), k))), 0)) END)"
)
BISECT = (
    "z AS (SELECT v, 0::DOUBLE AS low, 1000::DOUBLE AS high, 0 AS k FROM (SELECT DISTINCT {v} AS v FROM {source} WHERE {v} >= 1) UNION ALL "
    "SELECT v, CASE WHEN {share} < 0.95 THEN (low + high) / 2 ELSE low END, CASE WHEN {share} < 0.95 THEN high ELSE (low + high) / 2 END, k + 1 FROM z WHERE k < 60)"
)


def bisected(source: str, v: str) -> str:
    return BISECT.format(source=source, v=v, share=WITHIN_T.format(t="((low + high) / 2)"))


@query(
    "mean_interval",
    f"WITH RECURSIVE {BENCH}, s AS (SELECT solver, count(elapsed) AS n, avg(elapsed) AS mean, stddev_samp(elapsed) AS sd FROM b GROUP BY solver), {bisected('s', 'n - 1')} "
    "SELECT solver, n, round(mean, 6) AS mean, round(low * sd / sqrt(n), 5) AS half_width FROM s JOIN z ON z.v = s.n - 1 AND z.k = 60",
)
def mean_interval(spark, sf_dir):
    return rounded(rounded(S.mean_interval(bench(spark, sf_dir), ["solver"], "elapsed"), 6, "mean"), 5, "half_width")


@query(
    "student_interval",
    f"WITH RECURSIVE s AS (SELECT user_id AS run, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY ALL), {bisected('s', 'n - 1')} "
    "SELECT run, n, round(mean, 6) AS mean, round(low * sd / sqrt(n), 5) AS half_width FROM s LEFT JOIN z ON z.v = s.n - 1 AND z.k = 60",
)
def student_interval(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "value")
    return rounded(rounded(S.mean_interval(events, ["run"], "value"), 6, "mean"), 5, "half_width")


@query(
    "student_fit",
    "WITH RECURSIVE f AS (SELECT l_suppkey, ln(l_tax + 0.01) AS y, ln(l_discount + 0.01) AS x FROM lineitem), "
    "g AS (SELECT l_suppkey, count(*) AS n, regr_slope(y, x) AS slope, sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) / (count(*) - 2) / regr_sxx(y, x)) AS stderr FROM f GROUP BY l_suppkey), "
    f"{bisected('g', 'n - 2')}, h AS (SELECT *, n - 2 AS v, abs(slope / stderr) AS t FROM g WHERE n > 2) "
    f"SELECT l_suppkey, n, round(slope, 6) AS slope, round(low * stderr, 6) AS t_margin, round(1 - {WITHIN_T.format(t='t')}, 6) AS p_value FROM h JOIN z USING (v) WHERE z.k = 60",
)
def student_fit(spark, sf_dir):
    """Whether tax depends on the discount, for each supplier: slope of the logarithms, its margin and p-value."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") + 0.01).alias("x"), (F.col("l_tax") + 0.01).alias("y"))
    fit = V.loglog_fit(rows, ["l_suppkey"], "x", "y").where("n > 2")
    return rounded(fit, 6, "slope", "t_margin", "p_value").select("l_suppkey", "n", "slope", "t_margin", "p_value")


#: One lexicographic sweep as a recursion over anti-diagonals: a diagonal needs the one before it.
SWEEP = (
    "o AS (SELECT i, j, u, f, coalesce(lead(u) OVER x, 0) AS e, coalesce(lead(u) OVER y, 0) AS n FROM {source} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j)), "
    "d AS (SELECT 0 AS s, i, j, u FROM o WHERE i + j = 0 UNION ALL SELECT o.i + o.j, o.i, o.j, CASE WHEN o.i BETWEEN 1 AND 15 AND o.j BETWEEN 1 AND 15 THEN (o.f + ((o.e + w.u) * 256.0 + (o.n + t.u) * 256.0)) / 1024.0 ELSE o.u END "
    "FROM (SELECT DISTINCT s FROM d) c JOIN o ON o.i + o.j = c.s + 1 LEFT JOIN d w ON w.i = o.i - 1 AND w.j = o.j LEFT JOIN d t ON t.i = o.i AND t.j = o.j - 1)"
)


@query("gauss_seidel_wavefront", f"WITH RECURSIVE {FIELD}, {SWEEP.format(source='g')} SELECT i, j, u FROM d")
def gauss_seidel_wavefront(spark, sf_dir):
    """One lexicographic sweep over 16 tiles."""
    return wavefront.gauss_seidel(g17(spark, sf_dir), G, 1, 5).select("i", "j", "u")


@query(
    "ilu_wavefront",
    f"WITH RECURSIVE {FIELD}, o AS (SELECT i, j, f FROM g WHERE {within()}), "
    "p AS (SELECT 2 AS s, 1 AS i, 1 AS j, 1024.0::DOUBLE AS piv, f / 1024.0 AS y FROM o WHERE i + j = 2 UNION ALL "
    "SELECT s, i, j, piv, (f + 256.0 * coalesce(wy, 0) + 256.0 * coalesce(ty, 0)) / piv FROM (SELECT o.i + o.j AS s, o.i, o.j, o.f, 1024.0 - coalesce(65536.0 / w.piv, 0) - coalesce(65536.0 / t.piv, 0) AS piv, w.y AS wy, t.y AS ty "
    "FROM (SELECT DISTINCT s FROM p) c JOIN o ON o.i + o.j = c.s + 1 LEFT JOIN p w ON w.i = o.i - 1 AND w.j = o.j LEFT JOIN p t ON t.i = o.i AND t.j = o.j - 1)), "
    "q AS (SELECT 30 AS s, i, j, y AS z FROM p WHERE i + j = 30 UNION ALL SELECT p.s, p.i, p.j, p.y + (256.0 * coalesce(e.z, 0) + 256.0 * coalesce(n.z, 0)) / p.piv "
    "FROM (SELECT DISTINCT s FROM q) c JOIN p ON p.s = c.s - 1 LEFT JOIN q e ON e.i = p.i + 1 AND e.j = p.j LEFT JOIN q n ON n.i = p.i AND n.j = p.j + 1) "
    "SELECT g.i, g.j, round(coalesce(q.z, g.f), 9) AS z FROM g LEFT JOIN q ON q.i = g.i AND q.j = g.j",
)
def ilu_wavefront(spark, sf_dir):
    """ILU(0) applied to the source field over 16 tiles: pivots, forward and backward solve."""
    z = wavefront.TiledILU(G, 5).apply(g17(spark, sf_dir).select("i", "j", F.col("f").alias("r")))
    return z.select("i", "j", F.round("z", 9).alias("z"))


@query("solve_subdomains_coarse", spectral("f", "1 / lam", 4))
def solve_subdomains_coarse(spark, sf_dir):
    """Sixteen overlapping tiles with a coarse level."""
    out = solvers.solve_subdomains(boundary.zero(g17(spark, sf_dir), G).select("i", "j", "u", "f"), G, 4, 4, 1e-6, 60, coarse=True)
    return out.field.select("i", "j", (F.round("u", 4) + F.lit(0.0)).alias("u"))


#: Modes of every run, then steps of backward Euler judged by halving, until the time is reached.
ADAPTIVE = (
    f"WITH RECURSIVE {RUN_FIELD}, w AS (SELECT CAST(x AS INTEGER) AS a, CAST(y AS INTEGER) AS b, sin(x * y * pi() / 16) / sqrt(8.0) AS s FROM range(1, 16) p(x), range(1, 16) q(y)), "
    f"a AS (SELECT run_id, w.b AS k, j, sum(w.s * u) AS v FROM g JOIN w ON w.a = g.i WHERE {within()} GROUP BY ALL), b AS (SELECT run_id, k, w.b AS l, sum(w.s * v) AS v FROM a JOIN w ON w.a = a.j GROUP BY ALL), "
    "m AS MATERIALIZED (SELECT run_id, list(v ORDER BY k, l) AS c, list(1024 * (pow(sin(k * pi() / 32), 2) + pow(sin(l * pi() / 32), 2)) ORDER BY k, l) AS lam FROM b GROUP BY run_id), "
    "r AS (SELECT run_id, 0 AS step, 0::DOUBLE AS t, 0.004::DOUBLE AS h, 0::DOUBLE AS taken, 0::DOUBLE AS error, 0 AS tries, true AS kept, c FROM m UNION ALL "
    "SELECT run_id, step + CAST(error < 0.4 AS INTEGER), CASE WHEN error < 0.4 THEN t + taken ELSE t END, "
    "CASE WHEN error < 0.1 THEN least(2 * taken, taken * pow(0.4 / error, 0.5)) WHEN error < 0.4 THEN taken ELSE greatest(taken / 4, 0.8 * taken * pow(0.4 / error, 0.5)) END, taken, error, CASE WHEN kept THEN 1 ELSE tries + 1 END, error < 0.4, CASE WHEN error < 0.4 THEN two ELSE c END "
    "FROM (SELECT *, sqrt(list_sum(list_transform(range(1, len(c) + 1), lambda i: pow(two[i] - one[i], 2)))) AS error FROM ("
    "SELECT run_id, step, t, least(h, 0.02 - t) AS taken, tries, kept, r.c, list_transform(range(1, len(r.c) + 1), lambda i: r.c[i] / (1 + lam[i] * least(h, 0.02 - t))) AS one, list_transform(range(1, len(r.c) + 1), lambda i: r.c[i] / pow(1 + lam[i] * least(h, 0.02 - t) / 2, 2)) AS two "
    "FROM r JOIN m USING (run_id) WHERE t < 0.02 - 1e-12))) "
    "SELECT run_id, CAST(step AS INTEGER) AS step, round(t, 6) AS t, round(taken, 6) AS dt, round(error, 4) AS error, CAST(tries AS INTEGER) AS tries, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 4) AS norm FROM r WHERE kept AND step > 0"
)


@query("heat_adaptive_steps", ADAPTIVE)
def heat_adaptive_steps(spark, sf_dir):
    """The accepted steps of every line number's field, each run with a step of its own."""
    runs = runs17(spark, sf_dir).withColumn("alpha", F.lit(1.0))
    return rounded(rounded(timestep.march_adaptive(runs, G, 0.004, 0.02, 0.4), 6, "t", "dt"), 4, "error", "norm")


@query(
    "variant_props",
    "WITH p AS (SELECT event_type, CASE WHEN event_id % 7 = 3 THEN '{bad' WHEN event_id % 7 = 5 THEN replace(props, '}', ', \"tag\": \"' || event_type || '\"}') ELSE props END AS props FROM events), "
    "v AS (SELECT event_type, CASE WHEN json_valid(props) THEN props END AS j FROM p) "
    "SELECT event_type, count(*) AS n, count(j) AS parsed, CAST(sum(CAST(j->>'$.k' AS BIGINT)) AS BIGINT) AS total, count(j->>'$.tag') AS tagged, max(j->>'$.tag') AS tag, count(TRY_CAST(j->>'$.tag' AS BIGINT)) AS numbers, count(j->>'$.none') AS missing FROM v GROUP BY event_type",
)
def variant_props(spark, sf_dir):
    """Event properties as VARIANT, some of them malformed or with a further key: typed, wrongly typed and missing paths."""
    e, kind = _table(spark, sf_dir, "events"), F.col("event_id") % 7
    props = F.when(kind == 3, "{bad").when(kind == 5, F.replace("props", F.lit("}"), F.concat(F.lit(', "tag": "'), "event_type", F.lit('"}')))).otherwise(F.col("props"))
    rows = variants.parsed(e.select("event_type", props.alias("props")), "props")
    got = variants.extracted(rows, "props", {"k": ("$.k", "bigint"), "tag": ("$.tag", "string"), "number": ("$.tag", "bigint"), "none": ("$.none", "string")})
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("parsed"), F.sum("k").alias("total"), F.count("tag").alias("tagged"), F.max("tag").alias("tag"), F.count("number").alias("numbers"), F.count("none").alias("missing"))


LIMIT = 1.0
#: Split cells by how the field varies on their points, closed under what the neighbours need.
QUADTREE = (
    f"WITH RECURSIVE {FIELD}, l AS (SELECT level, CAST(power(2, 4 - level) AS INTEGER) AS size, CAST(power(2, level) AS INTEGER) AS n FROM range(4) t(level)), "
    "s AS (SELECT level, CAST(a.ci AS INTEGER) AS ci, CAST(b.cj AS INTEGER) AS cj FROM l, range(8) a(ci), range(8) b(cj), g WHERE a.ci < n AND b.cj < n AND i BETWEEN a.ci * size AND a.ci * size + size AND j BETWEEN b.cj * size AND b.cj * size + size GROUP BY ALL "
    f"HAVING max(u) - min(u) > {LIMIT}), "
    "r AS (SELECT CAST(level AS INTEGER) AS level, ci, cj FROM s UNION SELECT level - 1, (ci + di) // 2, (cj + dj) // 2 FROM r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj) WHERE level > 0 AND ci + di BETWEEN 0 AND power(2, level) - 1 AND cj + dj BETWEEN 0 AND power(2, level) - 1), "
    "k AS (SELECT level + 1 AS level, ci * 2 + a AS ci, cj * 2 + b AS cj FROM r, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b) UNION ALL SELECT 0, 0, 0), "
    "f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.level = k.level AND r.ci = k.ci AND r.cj = k.cj))"
)


@query("quadtree_leaves", f"{QUADTREE} SELECT CAST(level AS INTEGER) AS level, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, CAST(power(4, 4 - level) AS BIGINT) AS cells FROM f")
def quadtree_leaves(spark, sf_dir):
    """The adaptive regions of the field, in balance; the intervals must cover the square without a gap."""
    found = quadtree.leaves(quadtree.split_cells(g17(spark, sf_dir), 4, LIMIT), 4)
    return found.select("level", "ci", "cj", (F.col("z1") - F.col("z0")).alias("cells"))


@query("quadtree_quality", f"{QUADTREE} SELECT CAST(level AS INTEGER) AS level, count(*) AS leaves, round(sum(power(4, -level)), 9) AS share FROM f GROUP BY level")
def quadtree_quality(spark, sf_dir):
    return rounded(quadtree.quality(quadtree.leaves(quadtree.split_cells(g17(spark, sf_dir), 4, LIMIT), 4), 4), 9, "share")
