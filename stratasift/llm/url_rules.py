"""URL filtering by host-suffix and path-prefix rules.

Every distinct URL is expanded into the expressions that a rule could have
(each host suffix at a label boundary, with each path prefix of a length that
some rule has).  Expressions meet the rules by an equi-join on a short hash
prefix; the full digest confirms the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, quoted, read_table, require

#: Hex digits of SHA-256 on which expressions and rules are joined first.
HASH_PREFIX = 8

#: Above this many rules they are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 200_000

#: Rules of the registered query: (action, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and what is left of it after each dot."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def apply_url_rules(
    df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``df``.

    ``rules`` has ``action``, ``host`` and ``path``.  A rule fits its host and
    all subdomains if the URL's path starts with the rule's path.  Of several,
    the one with the longest host and path wins; of equally long ones the
    longer host, then ``block`` before ``allow``, then the text of the rule.

    Null URLs and URLs without ``://`` have an empty host and path; no rule
    with a host fits them, so they get ``default``.  Rules with a null host or
    action are ignored, a null path is empty, repeated rules count once.  Rows
    are kept one to one, repeated ones included; other columns pass through,
    but columns named like the four results are replaced.  URLs of any length
    are judged whole; an empty table gives an empty result.
    """
    require(df, url_col)
    spark = df.sparkSession
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("action").isNotNull())
        .select(
            "action",
            _lower_ascii(F.col("host")).alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
        )
        .distinct()
        .withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .withColumn("short", F.substring("digest", 1, HASH_PREFIX))
    )
    # How long a rule's path can be is a handful of numbers, whatever the rules' count.
    stats = rules.agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")
    ).first()
    lengths = stats["lengths"] or []
    small = stats["n"] <= BROADCAST_RULES
    key = F.coalesce(F.col(quoted(url_col)), F.lit(""))
    urls = df.select(key.alias("u")).distinct().select(
        "u", url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p")
    )
    prefixes = (
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("n"), F.substring("p", 1, n).alias("x")) for n in lengths]),
            lambda s: F.length(s["x"]) == s["n"],
        )
        if lengths
        else F.array().cast("array<struct<n:int,x:string>>")
    )
    expressions = (
        urls.withColumn("e_host", F.explode(host_suffixes(F.col("h"))))
        .withColumn("e_path", F.explode(F.transform(prefixes, lambda s: s["x"])))
        .select("u", F.sha2(F.concat_ws("\n", "e_host", "e_path"), 256).alias("e_digest"))
        .withColumn("short", F.substring("e_digest", 1, HASH_PREFIX))
    )
    if small:
        met = expressions.join(F.broadcast(rules), "short").where(F.col("e_digest") == F.col("digest"))
    else:
        # An expression such as a top-level domain stands in very many URLs: it meets the rules once,
        # and only expressions that are rules go back to their URLs, by a join that skew handling can split.
        known = expressions.select("short", "e_digest").distinct()
        hit = known.join(rules, "short").where(F.col("e_digest") == F.col("digest")).drop("short", "e_digest")
        met = expressions.join(hit, F.col("e_digest") == F.col("digest"))
    matched = (
        met
        .select(
            "u",
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("size"),
                F.length("r_host").alias("host_size"),
                (F.col("action") == "block").cast("int").alias("is_block"),
                F.concat("r_host", "r_path").alias("rule"),
                F.col("action").alias("action"),
            ).alias("hit"),
        )
        .groupBy("u")
        .agg(F.max("hit").alias("hit"))
    )
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # Only URLs that some rule hit have a row in `matched`.
    out = numbered(df, kept, u=key).join(matched, "u", "left")
    return out.select(
        *[f"c{i}" for i in range(len(kept))],
        url_host(F.col("u")),
        url_path(F.col("u")),
        F.col("hit.rule"),
        F.coalesce("hit.action", F.lit(default)),
    ).toDF(*kept, "host", "path", "rule", "verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_url_rules(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


# The rules are written out here, so that the SQL doesn't follow a mistake in RULES.
ORACLE_SQL = """
WITH rules(action, rh, rp) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parsed AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ranked AS (
  SELECT p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.action,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rh) + length(r.rp) DESC NULLS LAST) AS k
  FROM parsed p LEFT JOIN rules r
    ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE k = 1
"""
