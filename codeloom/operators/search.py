"""Symbol search by terms and BM25, and regular-expression search over lines."""

from __future__ import annotations

import math

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import search_terms, tokenize

K1, B = 1.2, 0.75


def postings(nodes: DataFrame) -> DataFrame:
    """(node_id, token, tf, length): terms of name (also split at case changes) and qualified name."""
    terms = search_terms(F.concat_ws(" ", tokenize(F.col("name")), F.col("qualified_name")))
    rows = nodes.select("node_id", terms.alias("t")).select("node_id", F.size("t").alias("length"), F.explode("t").alias("token"))
    return rows.groupBy("node_id", "token", "length").agg(F.count("*").alias("tf"))


def term_statistics(nodes: DataFrame) -> DataFrame:
    """One row: (docs, mean) symbols and the mean number of their terms."""
    length = F.size(search_terms(F.concat_ws(" ", tokenize(F.col("name")), F.col("qualified_name"))))
    return nodes.select(length.alias("length")).agg(F.count("*").alias("docs"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean"))


def symbol_search(nodes: DataFrame, query: str, limit: int = 20, *, index: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """Symbols that hold all terms of the query, the last one as a prefix, best BM25 first, then exported ones.

    ``index`` and ``statistics`` are stored ``postings`` and ``term_statistics``, so that a search reads the rows of its
    terms only; without them they are made here.
    """
    spark = nodes.sparkSession
    terms = spark.range(1).select(search_terms(tokenize(F.lit(query))).alias("t")).first()["t"]
    if not terms:
        return symbol_like(nodes, query, limit)
    index = postings(nodes) if index is None else index
    docs, mean = (term_statistics(nodes) if statistics is None else statistics).first()
    wanted = F.lit(False)
    for k, term in enumerate(terms):
        wanted = wanted | (F.col("token").startswith(term) if k == len(terms) - 1 else F.col("token") == term)
    # One pass over the rows of all terms: a row counts for each term that it fits.
    fits = F.array(*[F.when(F.col("token").startswith(term) if k == len(terms) - 1 else F.col("token") == term, F.lit(k)) for k, term in enumerate(terms)])
    hits = index.where(wanted).select("node_id", "length", "tf", F.explode(F.filter(fits, lambda x: x.isNotNull())).alias("k"))
    per = hits.groupBy("node_id", "length", "k").agg(F.sum("tf").alias("tf"))
    # A row for each term.
    df = {r["k"]: r["df"] for r in per.groupBy("k").agg(F.count("*").alias("df")).collect()}
    weight = F.lit(0.0)
    for k, n in df.items():
        weight = F.when(F.col("k") == k, F.lit(math.log(1 + (docs - n + 0.5) / (n + 0.5)))).otherwise(weight)
    score = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    total = per.withColumn("s", score).groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.sum("s"), 6).alias("score")).where(F.col("n") == len(terms)).drop("n")
    return total.join(nodes, "node_id").orderBy(F.desc("score"), F.desc("is_exported"), "node_id").limit(limit)


def symbol_like(nodes: DataFrame, part: str, limit: int = 20) -> DataFrame:
    return nodes.where(F.lower("name").contains(part.lower())).orderBy(F.desc("is_exported"), "name", "node_id").limit(limit)


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, line): lines end at a newline, lose one carriage return, and a last empty one does not count."""
    split = files.select("path", F.split("content", "\n").alias("lines")).select("path", "lines", F.size("lines").alias("n"))
    rows = split.select("path", F.posexplode("lines").alias("p", "line"), "n")
    kept = rows.where(~((F.col("p") == F.col("n") - 1) & (F.col("line") == "")))
    return kept.select("path", (F.col("p") + 1).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def valid_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise ValueError with the text of the error if the pattern is no regular expression."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e


def around(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hits`` (path, line_no, ...) with ``symbol``, the name of the outermost symbol around each line; null without one."""
    own = hits.columns
    known = nodes.select(F.col("path").alias("_p"), "name", "line_start", "line_end", "node_id")
    met = hits.join(known, (hits["path"] == known["_p"]) & hits["line_no"].between(F.col("line_start"), F.col("line_end")), "left")
    return met.groupBy(*own).agg(F.min_by("name", F.struct("line_start", "node_id")).alias("symbol"))


def search_code(files: DataFrame, pattern: str, nodes: DataFrame, suffix: str = "", limit: int | None = 50) -> DataFrame:
    """(path, line_no, line, symbol): matching lines, trimmed, and the outermost symbol around each."""
    valid_pattern(files.sparkSession, pattern)
    chosen = files.where(F.col("path").endswith(suffix)) if suffix else files
    hits = lines_of(chosen).where(F.col("line").rlike(pattern)).withColumn("line", F.regexp_replace("line", r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""))
    if limit:
        hits = hits.orderBy("path", "line_no").limit(limit)
    return around(hits, nodes)
