"""URL filters by expression expansion and short hash prefixes.

Each URL expands into expressions: the suffixes of its host, by whole labels, combined with the
prefixes of its path, both of the sizes that some rule has. An equi-join on the first hexadecimal digits of
an expression's SHA-256 finds the few rules that may fit; the full digest confirms them, and the
longest confirmed rule decides (then the longer host, then ``block``).

Equal URLs of a page are joined once and expanded again at the end. The rule side is broadcast only
if Spark's size statistics allow; otherwise the join shuffles, and hot expressions such as a
top-level domain are split by the skew join.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits no rule. Null page ids
are kept. Repeated rows give a row each. Rules with a null part are ignored; equal rules count once.
Very long paths are expanded at rule lengths only. Empty inputs give an empty result or default
verdicts. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hexadecimal digits of the short prefix: 32 bits.
PREFIX = 8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def host_suffixes(host: Column, depths: list[int]) -> Column:
    """Suffixes of the given numbers of labels: ``b.c`` is that of two for ``a.b.c``; an empty host has none."""
    labels = F.split(host, r"\.")
    wanted = F.array(*(F.lit(n) for n in depths)).cast("array<int>")
    return F.when(
        F.length(host) > 0,
        F.transform(
            F.filter(wanted, lambda n: n <= F.size(labels)),
            lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def expand(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Expressions (host, path) of a URL, for host suffixes and path prefixes of the given sizes."""
    prefixes = F.transform(
        F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    return F.flatten(F.transform(
        host_suffixes(host, depths), lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))
    ))


def digest_of(host: Column, path: Column) -> Column:
    # A zero byte cannot stand in a host, so no two expressions share the hashed string.
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict per row of ``pages``.

    ``rules``: host, path, verdict (``allow`` or ``block``). ``default`` is the verdict of URLs that
    no rule fits. The distinct (label count, path length) pairs of the rules come to the driver; URLs
    have at most some thousand characters, so they are few however many rules there are.
    """
    keyed = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    sizes = keyed.select(F.size(F.split("rule_host", r"\.")), F.length("rule_path")).distinct().collect()
    depths, lengths = (sorted({r[i] for r in sizes}) for i in (0, 1))
    keyed = keyed.withColumn("rule_digest", digest_of(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "rule_prefix", F.substring("rule_digest", 1, PREFIX))

    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")) \
        .groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    expressions = urls.withColumn("e", F.explode_outer(expand(F.col("host"), F.col("path"), depths, lengths))).select(
        "page_id", "host", "path", "copies", digest_of(F.col("e.h"), F.col("e.p")).alias("digest"))
    matched = expressions.withColumn("prefix", F.substring("digest", 1, PREFIX)).join(
        keyed, (F.col("prefix") == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")), "left")
    rank = F.when(F.col("rule_digest").isNotNull(), F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"),
    ))
    return (
        matched.groupBy("page_id", "host", "path", "copies").agg(F.max(rank).alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts),
fits AS (
  SELECT *,
    host = 'www.example.com' OR host LIKE '%.www.example.com' AS www,
    host = 'example.com' OR host LIKE '%.example.com' AS example,
    host = 'com' OR host LIKE '%.com' AS com,
    host = 'net' OR host LIKE '%.net' AS net
  FROM urls)
SELECT page_id, host, path,
  CASE WHEN www AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN example AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN com AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN www AND starts_with(path, '/en/') THEN 'allow'
       WHEN example AND starts_with(path, '/en/') THEN 'block'
       WHEN net AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
       ELSE 'allow' END AS verdict
FROM fits
"""
