"""URL filter: rules indexed by their rarest literal token.

Rules are of two kinds.  A host rule is a host and the start of a path; a pattern
rule is a regular expression with the literal tokens that each match must
contain.  Every rule is filed under the one of its tokens that is rarest among the
URLs at hand.  The tokens of a URL fetch the rules filed under them, and only those
run their regular expression.  Distinct URLs are judged once and joined back.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.llm.common import lower_ascii
from kelpgrid.session import materialize


@dataclass(frozen=True)
class Rule:
    """``rank``: host rules outrank patterns and longer rules shorter ones; null ``name``: the verdict is the method's own."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, name: str) -> Rule:
    """``org/fr/``: the host and all its subdomains, if the path starts with the rest of the name."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    # The last token of a path may go on in the URL, so it only counts where the rule ends it.
    whole = re.findall("[0-9A-Za-z]+", path if not path or not path[-1].isalnum() else re.sub("[0-9A-Za-z]+$", "", path))
    tokens = re.findall("[0-9a-z]+", host.lower()) + [t.lower() for t in whole]
    pattern = rf"^(?s:.*\.)?{re.escape(host.lower())}\x00{re.escape(path)}"
    return Rule(name, verdict, pattern, tuple(tokens), 1_000_000 + len(name))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression over host, NUL, path, A-Z lower-cased; ``tokens`` are whole tokens in any URL that it fits."""
    return Rule(None, verdict, pattern, tuple(tokens), len(pattern))


RULES = (
    host_rule("block", "net/"), host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"),
    # The method's own verdicts: paths of machinery and of adult or gambling sites.
    pattern_rule("block", r"\x00(?s:.*)/wp-login\.php", "wp", "login"),  # what follows may go on: .php5
    pattern_rule("block", r"\x00(?s:.*)/cgi-bin/", "cgi", "bin"),
    pattern_rule("block", r"(^|[^0-9a-z])casino([^0-9a-z]|$)", "casino"),
    pattern_rule("block", r"(^|[^0-9a-z])porn([^0-9a-z]|$)", "porn"),
    pattern_rule("block", r"(^|[^0-9a-z])viagra([^0-9a-z]|$)", "viagra"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def file_rules(spark: SparkSession, counts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, name, verdict, pattern, rank): every rule under its rarest token; rules without a token under the empty one.

    As many rows as rules; ``counts(token, n)`` of the URLs is only read for the tokens of rules.
    """
    table = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.rank, list(r.tokens) or [""]) for i, r in enumerate(rules)],
                                  "i int, name string, verdict string, pattern string, rank int, tokens array<string>")
    each = table.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
    best = each.groupBy("i").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return table.drop("tokens").join(best, "i")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``.

    Null URLs and those without ``://`` have empty host and path, no rule and the default
    verdict.  Of the host rules that fit, the longest decides (block wins a tie); if none
    fits, a fitting pattern decides with ``rule`` null, else ``default``.  Repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = rows.filter(F.col("url").isNotNull()).select("url").distinct()
    subject = F.concat("host", F.lit("\x00"), "path")
    tokens = F.array_union(F.array(F.lit("")), F.array_distinct(F.split(lower_ascii(subject), "[^0-9a-z]+")))
    urls = materialize(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("tokens", tokens))
    asked = urls.select("url", "host", "path", F.explode("tokens").alias("token"))
    counts = asked.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = file_rules(spark, counts, rules)
    if len(rules) <= 10_000:  # a bound on the rows of the index; beyond it Spark chooses the join
        filed = F.broadcast(materialize(filed))
    fits = asked.join(filed, "token").filter(F.rlike(F.when(F.col("name").isNull(), lower_ascii(subject)).otherwise(subject), F.col("pattern")))
    best = fits.groupBy("url").agg(F.max(F.struct("rank", "verdict", "name")).alias("best"))
    out = (rows.withColumnsRenamed({"url": "page_url"}).join(best, F.col("page_url") == F.col("url"), "left")
           .select("page_id", host_of(F.col("page_url")).alias("host"), path_of(F.col("page_url")).alias("path"),
                   F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
    return out
