"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

Everything is column expressions and small relations; scoring pages is one projection over
the scan, without an exchange. The classifier learns from a small labelled URL table of at
most ``LABELLED`` rows (a larger one is sampled by hash): its kernel matrix is an equi-join on
n-gram buckets, the fit a fixed number of full gradient steps over it, and the weights, one
for each of ``BUCKETS`` hash buckets whatever the input's size, reach the pages as the value
of a scalar subquery.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged
by the weights of those; urls of any length are read whole; repeated rows give equal
rows; a url at probability one half or more is blocked; an empty table gives no rows; other
columns of the table, whatever their names, are left out of the result. Labelled rows with a
null url or label are not learned from; without any labelled row every url scores one half and is blocked.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hash buckets of n-grams, a prime; the lengths of n-grams; labelled rows learned from at most.
BUCKETS, SIZES, LABELLED = 16381, (3, 4), 512
#: Steps of the fit, and how strongly weights are held down.
STEPS, DECAY = 300, 0.01
BASE = 1009
#: A rule list is part of every row's expression, so it must be short.
MOST_RULES = 500

#: Fixed values: (host, path, verdict) of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: The small labelled URL table, invented for this purpose: words that hosts to block and to allow are made of, two
#: each, and whole urls where the path tells. Hosts of both kinds get the same prefixes, endings and page paths, by
#: their names' CRC-32.
BLOCKED = "casino bets poker slots pills meds adult xxx ads track spam farm loans win cheap free".split()
ALLOWED = """library news museum garden history school river weather theatre station thinking other northern island author bakery
this that with have from they what ash should about bread ocean ninth table sensation hinterland""".split()
STEPS_APART = (1, 4, 7)
URLS = [
    ("http://files.example.net/casino/win/8", 1), ("http://pages.example.org/cheap-pills/buy", 1), ("https://host.example.com/adult/xxx/4", 1), ("http://site.example.net/sports-bets/now", 1),
    ("http://files.example.net/papers/2019/8", 0), ("http://pages.example.org/recipes/soup", 0), ("https://host.example.com/maps/north/4", 0), ("http://site.example.net/letters/spring", 0),
]
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), ("com", "net", "org")
PATHS = ("/en/{0}", "/de/{0}.html", "/fr/{0}/", "/es/{0}?page=2&ref=x", "/en/{0}#top")


def labelled_rows() -> list[tuple[str, int]]:
    rows = list(URLS)
    for block, names in ((1, BLOCKED), (0, ALLOWED)):
        for name in (f"{w}{'-' if k % 2 else ''}{names[(i + k) % len(names)]}" for k in STEPS_APART for i, w in enumerate(names)):
            n = zlib.crc32(name.encode())
            path = PATHS[n % len(PATHS)].format(n // 60 % 9000)
            rows.append((f"http://{PREFIXES[n // 15 % len(PREFIXES)]}{name}.example.{ENDINGS[n // 5 % len(ENDINGS)]}{path}", block))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block) of the small labelled table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, labelled_rows()))} AS t(url, block)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, its letters A to Z lower-cased, and path; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; nulls if none does.

    A rule fits its host and all subdomains, when the path starts with the rule's. Of rules of
    one length that both fit, the first in the list wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} belong in one expression")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def codes(text: Column) -> Column:
    """Code points of a text between marks for its ends."""
    points = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), F.ascii)
    return F.filter(points, lambda c: c > 0).cast("array<long>")


def features(df: DataFrame, *keep: str) -> DataFrame:
    """(keep…, grams array<struct<bucket, v>>) of rows with ``host`` and ``path``.

    The code points get a projection of their own, so that they are found once a row.
    """
    points = df.select(*keep, codes(F.col("host")).alias("__host"), codes(F.col("path")).alias("__path"))
    both = []
    for field, name in enumerate(("__host", "__path")):
        hashed = []
        for n in SIZES:
            code = f"coalesce(get({name}, i), 0L)"
            for k in range(1, n):
                code = f"({code}) * {BASE} + coalesce(get({name}, i + {k}), 0L)"
            hashed.append(f"transform(sequence(0, greatest(size({name}) - {n}, 0)), i -> int((({code}) * 4 + {2 * field + n % 2}) % {BUCKETS}))")
        both.append(f"transform(concat({', '.join(hashed)}), b -> struct(b AS bucket, 1D / sqrt(double(greatest(2 * size({name}) - {sum(SIZES) - 2}, 1))) AS v))")
    return points.select(*keep, F.expr(f"concat({', '.join(both)})").alias("grams"))


def train(spark: SparkSession, labelled: DataFrame, steps: int = STEPS, decay: float = DECAY) -> DataFrame:
    """One row (weights array<double>): a weight for each bucket, and the intercept at the end.

    ``labelled`` has (url string, block int). Gradient steps are taken in the span of the
    examples, w = sum of a_i x_i, where they need only the examples' inner products.
    """
    rows = labelled.where("url IS NOT NULL AND block IS NOT NULL").select(F.col("url").cast("string").alias("url"), F.col("block").cast("double").alias("y"))
    rows = rows.orderBy(F.crc32(F.col("url").cast("binary")), "url", "y").limit(LABELLED)
    rows = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "y"))).alias("all"))
    rows = rows.select(F.posexplode("all").alias("i", "row")).select("i", "row.*")
    host, path = split_url(F.col("url"))
    x = features(rows.select("i", "y", host.alias("host"), path.alias("path")), "i").select("i", F.inline("grams")).groupBy("i", "bucket").agg(F.sum("v").alias("v"))
    x = x.unionAll(rows.select("i", F.lit(BUCKETS), F.lit(1.0)))  # the intercept, which every two examples share
    other = x.select(F.col("i").alias("j"), "bucket", F.col("v").alias("u"))
    products = x.join(other, "bucket").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    lines = products.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("k"), F.sum("k").alias("reach"))
    lines = lines.join(rows.select("i", "y"), "i").select("reach", F.struct("i", "y", F.col("k.k").alias("k")).alias("e"))
    whole = lines.groupBy().agg(F.sort_array(F.collect_list("e")).alias("e"), (F.lit(4.0) / F.max("reach")).alias("rate"))
    step = f"transform(e, r -> a[r.i] + rate * (r.y - 1D / (1D + exp(-aggregate(zip_with(r.k, a, (u, v) -> u * v), 0D, (s, v) -> s + v))) - {decay} * a[r.i]))"
    a = whole.select(F.posexplode(F.expr(f"aggregate(sequence(1, {steps}), transform(e, r -> 0D), (a, t) -> {step})")).alias("i", "a"))
    weights = x.join(a, "i").groupBy("bucket").agg(F.sum(F.col("a") * F.col("v")).alias("w"))
    every = spark.range(BUCKETS + 1).select(F.col("id").alias("bucket")).join(weights, "bucket", "left")
    return every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("s")).select(F.col("s.w").alias("weights"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: DataFrame, *keep: str) -> DataFrame:
    """(keep…, host, path, rule, verdict, log_odds) of rows with ``url``; log_odds is the method's, rule or not."""
    host, path = split_url(F.col("url").cast("string"))
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("__kept")
    split = pages.select(kept, host.alias("host"), path.alias("path"))
    scored = features(split, "__kept", "host", "path").withColumn("__weights", model.select("weights").scalar())
    odds = F.expr(f"aggregate(concat(array(struct({BUCKETS} AS bucket, 1D AS v)), grams), 0D, (s, g) -> s + get(__weights, g.bucket) * g.v)")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = scored.select("__kept", "host", "path", rule.alias("rule"), verdict.alias("__verdict"), odds.alias("log_odds"))
    by_method = F.when(F.col("log_odds") >= 0, "block").otherwise("allow")
    return out.select("__kept.*", "host", "path", "rule", F.coalesce("__verdict", by_method).alias("verdict"), "log_odds")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("cast(page_id as long) page_id", "cast(url as string) url")
    return judge(pages, RULES, train(spark, labelled_urls(spark)), "page_id").drop("log_odds")
