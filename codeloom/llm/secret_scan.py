"""Secret scan with corpus-wide ownership: values that one owner has look live, those that many have are examples.

Matches come from regular expressions within the row: the pieces between them
(``split``) and the matches (``regexp_extract_all``) give their places. Besides the
base kinds there are candidates, long tokens that mix cases and digits as generated keys do.
Hashes of the values of base spans and candidates are counted by distinct owner and
repository over the whole corpus. A candidate becomes a span of kind ``live`` when its
value has at most ``most_owners`` owners and ``most_repos`` repositories; a base span stays
and counts as live or as a widely copied example by the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.shared import second_key, stash

#: Patterns of the base kinds in the order that spans of equal start are listed in. A run of AKIA
#: or hex characters is matched whole, so a least length in the pattern finds what dropping short matches would.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates for ``live``: runs of 20 or more that hold a digit and letters of both cases.
TOKEN = r"[A-Za-z0-9_+=-]{20,}"
KINDS = ("assign", "access", "hex", "live")


def _matches(text: Column, pattern: str, kind: int, holds) -> Column:
    """Array of (kind, pos, gap, size, value_sha256): all matches in order, with the code points between each and the one before.

    The hash is null where ``holds`` (of the value) is not true: such a match only has a place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    rows = F.transform(
        F.arrays_zip(pieces.alias("g"), found.alias("m"), value.alias("v")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.when(holds(x["v"]), F.sha2(x["v"], 256)).alias("value_sha256")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,size:int,value_sha256:string>>"))


def _located(rows: DataFrame) -> DataFrame:
    """(row, owner, repo, start, kind, end, value_sha256) of the spans: matches that hold, and candidates that no base span overlaps.

    Places are running totals over the matches of a row. Whether a base span reaches into a candidate follows from the
    farthest end among those that start no later and the nearest start among those that start no earlier.
    """
    each = rows.select("row", "owner", "repo", F.explode("matches").alias("m")).select("row", "owner", "repo", "m.*").repartition("row")
    ahead = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ahead).cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int")).where("value_sha256 is not null")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") < 3
    each = each.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(behind))
    free = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return each.where(base | free).select("row", "owner", "repo", "start", "kind", "end", "value_sha256")


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column, repo: Column, most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found), a row for each row of ``docs``.

    ``found`` has start, end, kind, value_sha256, owners and repos of each span. Null counts as an
    empty text; rows that repeat are scanned each and are of one owner. A null owner or repository
    counts as one named so. Spans that start at one place are listed by kind. Texts of any length are scanned whole, and the work grows
    with the matches of a text, not with their square. Without rows the result is empty; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sure = lambda v: F.length(v) >= 1
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    matches = F.concat(_matches(text, ASSIGN, 0, lambda v: F.length(v) >= 6), _matches(text, ACCESS, 1, sure), _matches(text, HEX, 2, sure), _matches(text, TOKEN, 3, mixed))
    # Only matches go on from here; the row number, fixed by the files, tells rows of one id apart.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), matches.alias("matches"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "matches")
    each = stash(_located(rows), "spans", small=True)
    counts = each.select("value_sha256", "owner", "repo").distinct().groupBy("value_sha256", "owner").agg(F.count("*").alias("r")).groupBy("value_sha256").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))
    counts = counts.withColumn("k", second_key(F.col("value_sha256")))
    known = each.withColumn("k", second_key(F.col("value_sha256"))).join(counts, ["value_sha256", "k"])
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    found = known.where((F.col("kind") < 3) | live).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value_sha256", "owners", "repos", live.alias("live")))).alias("found"))
    out = rows.select("id", "row").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    of = lambda k: F.filter("found", lambda x: x["kind"] == k)
    base_only = F.filter("found", lambda x: x["kind"] < 3)
    return out.select(
        "id",
        *[F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_listed(base_only), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
        F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("kind"), x["value_sha256"].alias("value_sha256"), x["owners"].alias("owners"), x["repos"].alias("repos"))).alias("found"),
    )
