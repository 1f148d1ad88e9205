"""URL filters with an index of pattern rules by their rarest literal token.

A rule is a regular expression on the site (host and path) or on the whole url. Literal tokens are the runs of letters
and digits in a pattern with a literal separator on both sides, so that every url that the pattern matches has them as
tokens. Each rule is filed under the one of its tokens that the fewest urls of the table have; urls look up the rules
of their own tokens, and only those run. Rules without a literal token are looked up by every url.

Host rules ("net/es/") fit a host, its subdomains and the paths that start with the rule's path; the longest decides.
Where none fits, a pattern rule decides: allow before block, and allow if none matches.

Nulls: a null url, or one without "://", has an empty host and path and is judged by the pattern rules alone (a null
by none). Very long urls are read whole. Of rules as long that fit, and of tokens as rare, the first by text decides, so ties are
settled alike on each run. Equal rows are judged alike and all kept. An empty table gives no rows. Columns named like this operator's are
replaced; others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import lower_ascii, table


@dataclass(frozen=True)
class UrlRule:
    """verdict: allow or block. A host rule has text like "net/es/"; a pattern rule has a regular expression."""

    verdict: str
    text: str
    pattern: bool = False

    def regex(self) -> str:
        if self.pattern:
            return self.text
        host, _, path = self.text.partition("/")
        return rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"

    def tokens(self) -> list[str]:
        """Tokens that any match has whole: those between literal separators, or at the anchored start of a host."""
        if not self.pattern:
            host, _, path = self.text.partition("/")
            return [*re.findall(r"[a-z0-9]+", host), *re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())]
        runs, run = [], ""
        for op, value in _parser.parse(self.text):
            if op is _parser.LITERAL:
                run += chr(value)
            else:
                runs, run = [*runs, run], ""
        return [t.lower() for r in [*runs, run] for t in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", r)]


HOST_RULES = (UrlRule("allow", "com/"), UrlRule("block", "example.com/en/"), UrlRule("allow", "www.example.com/en/"), UrlRule("block", "net/es/"), UrlRule("block", "net/fr/"))
PATTERN_RULES = (UrlRule("block", r"[?&]utm_source=feed", True), UrlRule("block", r"/[a-z]+/[0-9]+\.html$", True), UrlRule("allow", r"^https://[^/?#]*/de/", True))

_RULES = T.StructType([T.StructField("rule_no", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("regex", T.StringType()), T.StructField("rule_text", T.StringType()), T.StructField("rule_verdict", T.StringType()), T.StructField("is_pattern", T.BooleanType()), T.StructField("rank", T.LongType())])


def host_of(url: str) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def tokens_of(*texts: Column) -> Column:
    """The distinct tokens of a row, with the empty one, under which rules without tokens are filed."""
    found = F.filter(F.split(lower_ascii(F.concat_ws(" ", *texts)), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(found, F.array().cast("array<string>"))))


def rule_index(tokens: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Rules filed under their rarest token. tokens: one column of token arrays; all rows are counted, for the tokens that rules have."""
    spark = tokens.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens()})
    counts = dict.fromkeys(wanted, 0)
    if wanted:  # the answer has at most a row for each token of the rules
        vocabulary = spark.createDataFrame([(t,) for t in wanted], "token string")
        counts |= {r["token"]: r["count"] for r in tokens.select(F.explode("tokens").alias("token")).join(F.broadcast(vocabulary), "token", "left_semi").groupBy("token").count().collect()}
    rows = [(i, min(r.tokens(), key=lambda t: (counts[t], t), default=""), r.regex(), r.text, r.verdict, r.pattern, len(r.text)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, _RULES)


def filter_urls(pages: DataFrame, url: str = "url", host_rules: tuple[UrlRule, ...] = HOST_RULES, pattern_rules: tuple[UrlRule, ...] = PATTERN_RULES) -> DataFrame:
    """The rows with host, path, rule and verdict."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # the table's own columns travel in a struct, so none can clash with those made here
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(url).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    tokenised = parsed.withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("url")))
    index = rule_index(tokenised.select("tokens"), host_rules + pattern_rules)
    rows = tokenised.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode("tokens").alias("token")).drop("tokens")
    # the index has a row per rule: Spark broadcasts it where its size is below the threshold, and else shuffles
    tried = rows.join(index, "token", "left").withColumn("site", F.concat("host", "path"))
    fits = F.coalesce(F.when(F.col("is_pattern"), F.expr("rlike(url, regex)")).otherwise(F.expr("rlike(site, regex)")), F.lit(False))
    best = F.max(F.when(fits & ~F.col("is_pattern"), F.struct("rank", "rule_text", "rule_verdict")))
    pattern = F.min(F.when(fits & F.col("is_pattern"), F.col("rule_verdict")))  # allow sorts before block
    judged = tried.groupBy("row").agg(*[F.first(c).alias(c) for c in ("kept", "host", "path")], best.alias("best"), pattern.alias("pattern"))
    return judged.select("kept.*", "host", "path", F.col("best.rule_text").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.col("pattern"), F.lit("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(v, h, p)),
m AS (SELECT u.*, (SELECT max({'n': length(h || p), 'rule': h || p, 'v': v}) FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(url, '^https://[^/?#]*/de/') THEN 'allow'
                             WHEN regexp_matches(url, '[?&]utm_source=feed') OR regexp_matches(url, '/[a-z]+/[0-9]+\.html$') THEN 'block' END, 'allow') AS verdict
FROM m""",
}
