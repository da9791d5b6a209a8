"""URL filters by host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into one expression per suffix of its host and prefix of
its path, for the label counts and path lengths that occur in the rules, and
no others.  Expressions meet the rules on the first ``prefix_digits`` hex
digits of their SHA-256; a meeting counts once the full digests agree.  The
longest rule (host and path together, then host) decides.

Rules up to ``BROADCAST_RULES`` are broadcast, a bound of some 20 MB; beyond
it the join is shuffled on (prefix), of which the rule side is unique by
digest, so Spark can split large partitions.  The best rule per URL is found
by an aggregate that is partial before its exchange.

Defined cases: a null URL or one without ``://`` has empty host and path and
meets no rule; no rule gives verdict ``default``; repeated rows are judged one
by one; an empty table, or no rules, gives no matches; columns pass through,
except that result columns replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
#: (action, host, path) of the rules of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def rule_table(spark: SparkSession, rules=RULES, prefix_digits: int = 8) -> DataFrame:
    rows = [(a, h, p) for a, h, p in dict.fromkeys(rules)]
    df = spark.createDataFrame(rows, "action string, rule_host string, rule_path string")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    return df.select("action", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"), digest.alias("digest")).withColumn("prefix", F.left("digest", F.lit(prefix_digits)))


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    u = F.col(f"`{url}`")
    ok = F.coalesce(u.contains("://"), F.lit(False))
    rest = F.substring(u, F.instr(u, "://") + 3, F.length(u))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": F.when(ok, lower).otherwise(""), "path": F.when(ok, path).otherwise("")})


def judge(pages: DataFrame, url: str = "url", rules=RULES, default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """pages with host, path, rule (null without one) and verdict."""
    spark = pages.sparkSession
    df = parsed(pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"}]), url)
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = F.col("host"), F.col("path")
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    each = [F.when((n_labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.lit("\n"), F.left(path, F.lit(m)))) for n in labels for m in lengths]
    columns = df.columns
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    # A URL without an expression keeps one null, so that it stays in the result.
    digests = F.transform(F.filter(F.array(*each), lambda x: x.isNotNull()), lambda x: F.sha2(x, 256))
    wide = keyed.withColumn("_digest", F.explode_outer(digests)).withColumn("_prefix", F.left("_digest", F.lit(prefix_digits)))
    known = rule_table(spark, rules, prefix_digits)
    known = F.broadcast(known) if len(rules) <= BROADCAST_RULES else known
    met = wide.join(known, (F.col("_prefix") == F.col("prefix")) & (F.col("_digest") == F.col("digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_length", "rule", "action"))).alias("_best")
    out = met.groupBy("_row", *[F.col(f"`{c}`") for c in columns]).agg(best)
    return out.select(*[F.col(f"`{c}`") for c in columns], F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))
