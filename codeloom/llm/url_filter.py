"""URL filters: rules indexed by their rarest literal token, so that few rules run their pattern on a URL."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shared import second_key

#: The index is broadcast up to so many rules of at most PATTERN_CHARS; beyond, it is joined by shuffle.
MOST_BROADCAST = 20_000
PATTERN_CHARS = 500


@dataclass(frozen=True)
class Rule:
    """``verdict`` is block or allow. A rule of a host and a path fits the host, its subdomains and paths that start with it;
    a rule of a pattern fits URLs in which the regular expression is found. ``tokens`` are words (runs of a-z and 0-9
    between other characters) that every fitting URL has, in lower case."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return self.host + self.path if self.host else self.pattern

    def regex(self) -> str:
        if not self.host:
            return self.pattern
        # The atomic group keeps to the first "://".
        return r"(?s)^(?>.*?://)(?:[^/?#]*\.)?(?i:" + re.escape(self.host) + r")(?=[/?#]|$)" + re.escape(self.path)

    def literals(self) -> list[str]:
        if not self.host:
            return sorted(set(self.tokens))
        whole = self.path[: self.path.rfind("/") + 1] if not self.path.endswith("/") else self.path
        return sorted(set(re.findall(r"[a-z0-9]+", f"{self.host} {whole}".lower())))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    low = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, "[^a-z0-9]+"), ""))


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [{"rule_no": k, "verdict": r.verdict, "host": r.host, "path": r.path, "text": r.text, "regex": r.regex(), "tokens": r.literals()} for k, r in enumerate(rules)]
    kind = "array<struct<rule_no:int,verdict:string,host:string,path:string,text:string,regex:string,tokens:array<string>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")


def judge_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Of fitting host rules the longest wins (of equal ones, the first listed) and is named in ``rule``. Else the
    patterns decide: allow if one that allows fits, block if one that blocks does, allow if none; ``rule`` is then null.
    The verdict follows from the URL alone, so each distinct URL is judged once, whatever its length and however often it is there.
    A null URL, or one without ``://``, has an empty host and path and is judged by patterns (a null one is allowed).
    Without pages or rules the result is empty or all allowed. Columns of ``pages`` named like a new one give way to it.
    """
    spark = pages.sparkSession
    if any(not r.literals() for r in rules) or any(len(r.regex()) > PATTERN_CHARS for r in rules):
        raise ValueError("each rule needs a literal token and a short pattern")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").distinct()
    words = urls.select("u", F.explode(tokens_of(F.col("u"))).alias("token"))
    table = _rule_table(spark, rules)
    share = (lambda d: F.broadcast(d)) if len(rules) <= MOST_BROADCAST else (lambda d: d)
    literals = table.select("rule_no", F.explode("tokens").alias("token"))
    counts = words.join(share(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = literals.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = table.join(rarest, "rule_no").select("rule_no", "verdict", "host", "path", "text", "regex", "token")
    fits = words.join(share(index), "token").where(F.expr("u rlike regex"))
    best = fits.groupBy("u").agg(
        F.max(F.when(F.col("host") != "", F.struct(F.length("text").alias("n"), (-F.col("rule_no")).alias("k"), "text", "verdict"))).alias("b"),
        F.max(F.expr("host = '' and verdict = 'allow'")).alias("spared"),
        F.max(F.expr("host = '' and verdict = 'block'")).alias("blocked"),
    )
    verdict = F.when(F.col("b").isNotNull(), F.col("b.verdict")).when(F.col("blocked") & ~F.col("spared"), F.lit("block")).otherwise(F.lit("allow"))
    found = best.select(F.col("u").alias("_u"), second_key(F.col("u")).alias("_uk"), F.col("b.text").alias("rule"), verdict.alias("_verdict"))
    # A frequent URL is split by adaptive execution, for which both sides must be dealt anew; null ones match nothing and are spread.
    rows = pages.select(F.struct(*[f"`{c}`" for c in own]).alias("_row"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("_k", F.when(F.col("_url").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")).otherwise(second_key(F.col("_url"))))
    joined = rows.join(found, (F.col("_url") == F.col("_u")) & (F.col("_k") == F.col("_uk")), "left")
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"))


#: The rules of the op10 query, and patterns for hosts and paths that no rule names.
CONTRACT_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]
PATTERN_RULES = [
    Rule("block", pattern=r"(?i)[/.@]spam-farm\.", tokens=("spam", "farm")),
    Rule("block", pattern=r"(?i)[/.@]cheap-pills\.", tokens=("cheap", "pills")),
    Rule("block", pattern=r"(?i)[/.@-]casino[.-]", tokens=("casino",)),
    Rule("block", pattern=r"(?i)[/.@-]porn[.-]", tokens=("porn",)),
    Rule("block", pattern=r"(?i)/wp-login\.php", tokens=("wp", "login", "php")),
    Rule("allow", pattern=r"(?i)://[^/?#]*\.edu(?=[/?#]|$)", tokens=("edu",)),
]
