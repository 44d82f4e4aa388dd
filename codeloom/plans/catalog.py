"""Every query of the library by name, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import communities as C
from codeloom.operators import graph as G
from codeloom.operators import relational as R
from codeloom.operators import resolve as V
from codeloom.operators import search as S
from codeloom.plans.demo import oracle, view
from codeloom.plans.lineage import cut
from codeloom.sources import frontends
from codeloom.sources.files import keep_files
from codeloom.streaming import changes as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (t, spark) -> DataFrame, where t(name) is a table or view."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name), spark)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def seeds(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("node_id"))


def levels_sql(seeds: str, depth: int, reverse: bool, edges: str = "edg") -> str:
    """Common table expressions l0 .. l<depth> from the query ``seeds`` (node_id), each without what earlier levels hold, and ``reached``."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    out = [f"adj AS MATERIALIZED (SELECT {a} AS a, {b} AS b, max(confidence) AS c FROM {{{edges}}} WHERE target_id IS NOT NULL GROUP BY 1, 2)"]
    out.append(f"l0 AS MATERIALIZED (SELECT CAST(node_id AS BIGINT) AS seed, CAST(node_id AS BIGINT) AS node_id, 0 AS depth, CAST(1 AS DOUBLE) AS confidence FROM ({seeds}) z)")
    out.append("s0 AS MATERIALIZED (SELECT seed, node_id FROM l0)")
    for k in range(1, depth + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT f.seed, e.b AS node_id, {k} AS depth, max(f.confidence * e.c) AS confidence FROM l{k - 1} f JOIN adj e ON e.a = f.node_id ANTI JOIN s{k - 1} q ON q.seed = f.seed AND q.node_id = e.b GROUP BY f.seed, e.b)")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT seed, node_id FROM l{k})")
    reached = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, depth + 1))
    return "WITH " + ", ".join(out) + f", reached AS MATERIALIZED ({reached})"


# --- sources -------------------------------------------------------------------------------------------


@query("SELECT path, language, size FROM {doc_files} WHERE language IN ('en', 'de', 'fr', 'es')")
def scan_files(t, spark):
    return t("doc_files").where(F.col("language").isin("en", "de", "fr", "es")).select("path", "language", "size")


@query("SELECT path FROM {doc_files} WHERE NOT regexp_matches(path, '^/proj/src1[0-9]/') AND NOT regexp_matches(path, '\\.fr$')")
def filter_ignore_glob(t, spark):
    return keep_files(t("doc_files"), root="/proj", ignore=["src1?/", "*.fr"]).select("path")


@query("SELECT path, size FROM {doc_files} WHERE size <= 4096")
def filter_max_size(t, spark):
    return keep_files(t("doc_files"), root="/proj", max_size=4096).select("path", "size")


@query("SELECT node_id, CASE node_id % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'rust' WHEN 2 THEN 'cpp' END AS language FROM {sym}")
def detect_language(t, spark):
    path = F.concat("path", F.lit("."), F.get(F.array(*[F.lit(x) for x in ("ts", "rs", "hpp", "txt")]), (F.col("node_id") % 4).cast("int")))
    return t("sym").select("node_id", X.language_of(path).alias("language"))


@query("SELECT node_id, kind, name, qualified_name, path, is_exported, complexity, line_start, line_end FROM {sym}")
def scan_nodes(t, spark):
    return t("sym").select("node_id", "kind", "name", "qualified_name", "path", "is_exported", "complexity", "line_start", "line_end").orderBy("path", "line_start")


@query("SELECT source_id, target_id, edge_type, round(confidence, 6) AS confidence FROM {edg}")
def scan_edges(t, spark):
    return t("edg").withColumn("confidence", F.round("confidence", 6))


@query("SELECT node_id, qualified_name, path FROM {sym} WHERE path <> '/proj/small/Brand_11.ts'")
def registry_scan(t, spark):
    return t("sym").where(F.col("path") != "/proj/small/Brand_11.ts").select("node_id", "qualified_name", "path")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module FROM {pages}")
def extract_imports(t, spark):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module"))


@query("SELECT doc_id, CAST(1 + len(regexp_extract_all(text, 'tion|\\bthe\\b|\\bde\\b')) AS INT) AS complexity FROM {documents}")
def branch_count(t, spark):
    return t("documents").select("doc_id", X.branch_count(F.col("text"), r"tion|\bthe\b|\bde\b").alias("complexity"))


def extracted(t):
    return frontends.tables(frontends.extract(t("code")))


@query("""SELECT path, CASE WHEN k = 4 THEN 'method' ELSE 'function' END AS kind, name, concat(path, CASE WHEN k = 4 THEN '.C.' ELSE '.' END, name) AS qualified_name, 3 AS line_start, CASE k WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END AS line_end,
  CASE k WHEN 0 THEN '(a: number)' WHEN 1 THEN '(a)' WHEN 2 THEN '(a: i32)' WHEN 3 THEN '(a int)' ELSE '(int a)' END AS signature, CASE k WHEN 0 THEN 'number' WHEN 1 THEN 'int' WHEN 2 THEN 'i32' WHEN 3 THEN 'int' END AS return_type,
  CASE WHEN k = 4 THEN concat(path, '.C') END AS receiver_type, k IN (0, 2) OR (k = 3 AND regexp_matches(name, '^[A-Z]')) AS is_exported, CASE k WHEN 0 THEN 3 WHEN 2 THEN 3 ELSE 2 END AS complexity FROM {code}
  UNION ALL SELECT path, 'class', 'C', concat(path, '.C'), 2, 7, NULL, NULL, NULL, false, 0 FROM {code} WHERE k = 4""")
def extract_symbols(t, spark):
    return extracted(t)[0].select("path", "kind", "name", "qualified_name", "line_start", "line_end", "signature", "return_type", "receiver_type", "is_exported", "complexity")


@query("""SELECT path, CASE k WHEN 0 THEN 'd' WHEN 3 THEN 'd.Run' WHEN 4 THEN 'Dep.run' ELSE concat(name, '_dep') END AS callee, 4 AS line, CASE k WHEN 0 THEN 11 WHEN 1 THEN 11 WHEN 2 THEN 19 WHEN 3 THEN 20 ELSE 24 END AS col,
  concat(path, CASE WHEN k = 4 THEN '.C.' ELSE '.' END, name) AS caller_qualified FROM {code}""")
def extract_calls(t, spark):
    return extracted(t)[1].select("path", "callee", "line", "col", "caller_qualified")


@query("SELECT path, CASE k WHEN 0 THEN 'd' WHEN 3 THEN 'd' WHEN 4 THEN 'Dep' ELSE concat(name, '_dep') END AS local_name, CASE k WHEN 0 THEN './dep' WHEN 1 THEN './dep' WHEN 2 THEN concat('dep::', name, '_dep') WHEN 3 THEN 'x/dep' ELSE 'x.Dep' END AS module FROM {code}")
def extract_modules(t, spark):
    return extracted(t)[2].select("path", "local_name", "module")


@query("SELECT path, CASE WHEN k IN (0, 1) THEN concat('/src/dep', CASE k WHEN 0 THEN '.ts' ELSE '.py' END) WHEN k = 2 THEN concat('dep::', name, '_dep') WHEN k = 3 THEN 'x/dep' ELSE 'x.Dep' END AS module_path FROM {code}")
def resolve_modules(t, spark):
    rows = extracted(t)[2]
    return rows.select("path", X.module_file(F.col("path"), F.col("module")).alias("module_path"))


@query("SELECT doc_id, md5(text) AS content_hash FROM {documents}")
def content_hash(t, spark):
    return t("documents").select("doc_id", F.md5("text").alias("content_hash"))


# --- sinks and mutations ---------------------------------------------------------------------------------


@query("SELECT file_id, path, CASE WHEN file_id % 3 = 0 THEN md5(content || 'x') ELSE content_hash END AS content_hash FROM {doc_files} UNION ALL SELECT file_id + 1000000, path || '.new', content_hash FROM {doc_files} WHERE file_id % 5 = 0")
def upsert_files(t, spark):
    old = t("doc_files").select("file_id", "path", "content_hash")
    changed = t("doc_files").where("file_id % 3 = 0").select((F.col("file_id") + 500000).alias("file_id"), "path", F.md5(F.concat("content", F.lit("x"))).alias("content_hash"))
    added = t("doc_files").where("file_id % 5 = 0").select((F.col("file_id") + 1000000).alias("file_id"), F.concat("path", F.lit(".new")).alias("path"), "content_hash")
    return R.upsert(old, changed.unionByName(added), "path", "file_id")


@query("SELECT source_id, target_id, edge_type, path, line, round(max(confidence), 6) AS confidence FROM {nullable} WHERE target_id IS NOT NULL GROUP BY source_id, target_id, edge_type, path, line UNION ALL SELECT source_id, target_id, edge_type, path, line, round(confidence, 6) FROM {nullable} WHERE target_id IS NULL")
def dedup_edges(t, spark):
    return R.dedup_edges(t("nullable")).withColumn("confidence", F.round("confidence", 6))


@query("WITH gone AS (SELECT node_id FROM {sym} WHERE path LIKE '/proj/small/%') SELECT source_id, CASE WHEN target_id IN (SELECT node_id FROM gone) THEN NULL ELSE target_id END AS target_id, round(confidence, 6) AS confidence FROM {edg} WHERE source_id NOT IN (SELECT node_id FROM gone)")
def delete_cascade(t, spark):
    files = t("sym").where("path like '/proj/small/%'").select("path", F.lit(0).cast("long").alias("file_id")).distinct()
    imports = t("imp").select(F.col("file_id").alias("importer_file_id"), F.col("needs").alias("imported_file_id"))
    edges = R.delete_cascade(t("sym"), t("edg"), imports, files)[1]
    return edges.select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


@query("SELECT node_id, path FROM {sym} WHERE path NOT LIKE '/proj/small/%'")
def delete_cascade_nodes(t, spark):
    files = t("sym").where("path like '/proj/small/%'").select("path", F.lit(0).cast("long").alias("file_id")).distinct()
    return R.delete_cascade(t("sym"), t("edg"), t("imp").select(F.col("file_id").alias("importer_file_id"), F.col("needs").alias("imported_file_id")), files)[0].select("node_id", "path")


@query("WITH gone AS (SELECT o_orderkey AS f FROM {orders} WHERE o_orderstatus = 'F') SELECT file_id AS importer_file_id, needs AS imported_file_id FROM {imp} WHERE file_id NOT IN (SELECT f FROM gone) AND needs NOT IN (SELECT f FROM gone)")
def delete_cascade_imports(t, spark):
    files = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"), F.lit("").alias("path"))
    return R.delete_cascade(t("sym"), t("edg"), t("imp").select(F.col("file_id").alias("importer_file_id"), F.col("needs").alias("imported_file_id")), files)[2]


@query("SELECT file_id, path FROM {doc_files} WHERE language <> 'fr'")
def delete_files(t, spark):
    return R.delete_files(t("doc_files"), t("doc_files").where("language = 'fr'")).select("file_id", "path")


@query("SELECT node_id, name FROM {sym} WHERE kind <> 'class' UNION ALL SELECT node_id, name FROM {sym} WHERE kind = 'class'")
def insert_nodes(t, spark):
    old, new = t("sym").where("kind <> 'class'").select("node_id", "name"), t("sym").where("kind in ('class', 'method')").select("node_id", "name")
    return R.append(old, new.unionByName(new), "node_id")


@query("SELECT DISTINCT file_id AS importer_file_id, needs AS imported_file_id FROM {imp}")
def import_edges(t, spark):
    return t("imp").select(F.col("file_id").alias("importer_file_id"), F.col("needs").alias("imported_file_id")).distinct()


TOKENS = "lower(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ', 'g'))"
POSTINGS = f"SELECT node_id, len(t) AS length, unnest(t) AS token FROM (SELECT node_id, list_filter(string_split_regex(concat({TOKENS}, ' ', lower(qualified_name)), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {{sym}})"


@query(f"SELECT node_id, token, CAST(length AS INT) AS length, count(*) AS tf FROM ({POSTINGS}) GROUP BY node_id, token, length")
def fts_postings(t, spark):
    return S.postings(t("sym"))


# --- lookups ---------------------------------------------------------------------------------------------


@query("SELECT file_id, path, content_hash FROM {doc_files} WHERE path = '/proj/src7/7.en'")
def lookup_file(t, spark):
    return t("doc_files").where(F.col("path") == "/proj/src7/7.en").select("file_id", "path", "content_hash")


@query("SELECT node_id, kind, name FROM {sym} WHERE node_id = 42")
def lookup_node(t, spark):
    return t("sym").where("node_id = 42").select("node_id", "kind", "name")


@query("SELECT node_id, name, path, line_start FROM {sym} WHERE name = (SELECT min(name) FROM {sym})")
def nodes_by_name(t, spark):
    least = t("sym").agg(F.min("name").alias("name"))
    return t("sym").join(F.broadcast(least), "name", "left_semi").select("node_id", "name", "path", "line_start").orderBy("path", "line_start")


@query("SELECT node_id, qualified_name FROM {sym} WHERE qualified_name = (SELECT min(qualified_name) FROM {sym}) ORDER BY line_start DESC LIMIT 1")
def lookup_qualified(t, spark):
    least = t("sym").agg(F.min("qualified_name").alias("qualified_name"))
    return t("sym").join(F.broadcast(least), "qualified_name", "left_semi").orderBy(F.desc("line_start")).limit(1).select("node_id", "qualified_name")


@query("SELECT node_id, kind, name, line_start, line_end FROM {sym} WHERE path = (SELECT min(path) FROM {sym})")
def file_outline(t, spark):
    least = t("sym").agg(F.min("path").alias("path"))
    return t("sym").join(F.broadcast(least), "path", "left_semi").select("node_id", "kind", "name", "line_start", "line_end").orderBy("line_start")


@query("SELECT target_id, edge_type, line, round(confidence, 6) AS confidence FROM {nullable} WHERE source_id = 42")
def edges_out(t, spark):
    return t("nullable").where("source_id = 42").select("target_id", "edge_type", "line", F.round("confidence", 6).alias("confidence"))


@query("SELECT source_id, edge_type, line, round(confidence, 6) AS confidence FROM {multi} WHERE target_id = 42")
def edges_in(t, spark):
    return t("multi").where("target_id = 42").select("source_id", "edge_type", "line", F.round("confidence", 6).alias("confidence"))


@query("SELECT needs, file_id FROM {imp}")
def reverse_deps(t, spark):
    return t("imp").select("needs", "file_id")


@query("SELECT e.source_id, s.qualified_name FROM {edg} e JOIN {sym} s ON s.node_id = e.source_id WHERE e.target_id = 42")
def callers_direct(t, spark):
    return t("edg").where("target_id = 42").join(t("sym"), F.col("source_id") == F.col("node_id")).select("source_id", "qualified_name")


@query("SELECT e.target_id, s.qualified_name FROM {edg} e JOIN {sym} s ON s.node_id = e.target_id WHERE e.source_id = 42")
def callees_direct(t, spark):
    return t("edg").where("source_id = 42").join(t("sym"), F.col("target_id") == F.col("node_id")).select("target_id", "qualified_name")


@query("SELECT source_id, target_id, line FROM {multi} WHERE lower(edge_type) = 'calls' AND target_id IS NOT NULL")
def resolved_edges(t, spark):
    return t("multi").where("lower(edge_type) = 'calls' and target_id is not null").select("source_id", "target_id", "line")


@query("SELECT node_id, CASE WHEN node_id % 2 = 0 THEN qualified_name ELSE concat('/proj/', name) END AS resolved FROM {sym}")
def resolve_qname(t, spark):
    given = F.when(F.col("node_id") % 2 == 0, F.col("qualified_name")).otherwise(F.col("name"))
    return t("sym").select("node_id", X.resolve_qname(given, "/proj").alias("resolved"))


@query("SELECT node_id, qualified_name FROM {ctor} WHERE kind IN ('function', 'method') AND NOT is_exported AND node_id NOT IN (SELECT target_id FROM {sparse}) AND string_split(qualified_name, '.')[-1] <> string_split(qualified_name, '.')[-2] AND name NOT IN ('main', 'initialize', 'default', 'from', 'into', 'try_into') AND NOT regexp_matches(name, '^(test_|Test|__|default_|bench_)') AND NOT ends_with(name, '_test')")
def dead_code(t, spark):
    return G.dead_code(t("ctor"), t("sparse")).select("node_id", "qualified_name")


@query("SELECT node_id, path, line_start FROM {sym} WHERE name = 'main' OR (is_exported AND kind = 'function' AND NOT regexp_matches(name, '^(test_|bench_)')) ORDER BY path, line_start, node_id LIMIT 20")
def entry_points(t, spark):
    return R.entry_points(t("sym")).select("node_id", "path", "line_start")


@query("SELECT path FROM {doc_files} WHERE ends_with(path, '.en')")
def glob_suffix_filter(t, spark):
    return t("doc_files").where(F.col("path").endswith(X.glob_suffix("src/**/*.en"))).select("path")


# --- references and search ---------------------------------------------------------------------------------


@query("SELECT m.source_id, s.qualified_name AS caller, s.path AS file, m.line, round(m.confidence, 6) AS confidence FROM {multi} m JOIN {sym} s ON s.node_id = m.source_id WHERE m.target_id = 77")
def find_references(t, spark):
    return R.find_references(t("multi").drop("path"), t("sym"), 77).withColumn("confidence", F.round("confidence", 6))


@query("SELECT n.line, n.target_id, coalesce(s.qualified_name, 'unresolved') AS definition, round(n.confidence, 6) AS confidence FROM {nullable} n LEFT JOIN {sym} s ON s.node_id = n.target_id WHERE n.source_id = 77")
def find_definition(t, spark):
    return R.find_definition(t("nullable"), t("sym"), 77).withColumn("confidence", F.round("confidence", 6))


LINES = """SELECT path, CAST(i AS INT) AS line_no, regexp_replace(l[i], '\\r$', '') AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM {crlf}), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE NOT (i = len(l) AND l[i] = '')"""


@query(LINES)
def lines_of(t, spark):
    return S.lines_of(t("crlf"))


# Every text is a file whose first symbols lie around its lines.
@query(f"WITH h AS (SELECT path, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ({LINES}) WHERE regexp_matches(line, '[0-9][0-9][0-9]')) SELECT h.path, h.line_no, h.line, min_by(s.name, s.line_start * 100000000 + s.node_id) AS symbol FROM h LEFT JOIN {{lined}} s ON s.path = h.path AND h.line_no BETWEEN s.line_start AND s.line_end GROUP BY ALL")
def search_code(t, spark):
    return S.search_code(t("crlf"), "[0-9][0-9][0-9]", t("lined"), limit=None)


@query(f"SELECT path, line_no FROM ({LINES}) WHERE regexp_matches(line, 'the|der') AND ends_with(path, '.en') ORDER BY path, line_no LIMIT 50")
def search_code_limit(t, spark):
    return S.search_code(t("crlf"), "the|der", t("lined"), X.glob_suffix("src/**/*.en")).select("path", "line_no")


@query("SELECT p AS line_no, x.path, min_by(s.name, CAST(s.line_start AS BIGINT) * 100000000 + s.node_id) AS symbol FROM (SELECT path, CAST(line_start + 3 AS INT) AS p FROM {sym}) x JOIN {sym} s ON s.path = x.path AND x.p BETWEEN s.line_start AND s.line_end GROUP BY p, x.path")
def enclosing_symbol(t, spark):
    points = t("sym").select("path", (F.col("line_start") + 3).cast("int").alias("line_no")).distinct()
    return S.around(points, t("sym"))


def bm25_sql(terms: list[str]) -> str:
    ctes = [f"p AS (SELECT node_id, token, length, count(*) AS tf FROM ({POSTINGS}) GROUP BY node_id, token, length)", "st AS (SELECT (SELECT count(*) FROM {sym}) AS docs, (SELECT avg(length) FROM (SELECT DISTINCT node_id, length FROM p)) AS mean)"]
    for k, term in enumerate(terms):
        test = f"starts_with(token, '{term}')" if k == len(terms) - 1 else f"token = '{term}'"
        ctes.append(f"h{k} AS (SELECT node_id, length, sum(tf) AS tf FROM p WHERE {test} GROUP BY node_id, length)")
        ctes.append(f"s{k} AS (SELECT node_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s FROM h{k}, st, (SELECT count(*) AS df FROM h{k}) d)")
    total = " + ".join(f"s{k}.s" for k in range(len(terms)))
    joins = " ".join(f"JOIN s{k} USING (node_id)" for k in range(1, len(terms)))
    return f"WITH {', '.join(ctes)} SELECT node_id, round({total}, 6) AS score, n.name FROM s0 {joins} JOIN {{sym}} n USING (node_id) ORDER BY score DESC, n.is_exported DESC, node_id LIMIT 20"


@query(bm25_sql(["small", "bra"]))
def symbol_search(t, spark):
    return S.symbol_search(t("sym"), "small bra").select("node_id", "score", "name")


@query("SELECT node_id, name FROM {sym} WHERE contains(lower(name), 'a') ORDER BY is_exported DESC, name, node_id LIMIT 20")
def symbol_like(t, spark):
    return S.symbol_like(t("sym"), "A").select("node_id", "name")


@query("SELECT node_id, " + TOKENS.replace("name,", "concat(name, 'HTTPRequest_getUserID'),", 1) + " AS tokens FROM {sym}")
def tokenize(t, spark):
    return t("sym").select("node_id", X.tokenize(F.concat("name", F.lit("HTTPRequest_getUserID"))).alias("tokens"))


# --- aggregations --------------------------------------------------------------------------------------------


@query("SELECT 'files' AS metric, count(*) AS value FROM {doc_files} UNION ALL SELECT 'nodes', count(*) FROM {sym} UNION ALL SELECT 'edges', count(*) FROM {edg} UNION ALL SELECT 'import_edges', count(*) FROM {imp}")
def index_status(t, spark):
    return R.index_status(t("doc_files"), t("sym"), t("edg"), t("imp"))


@query("SELECT language, count(*) AS n_files FROM {doc_files} GROUP BY language")
def language_distribution(t, spark):
    return t("doc_files").groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "language")


@query("SELECT s.node_id, s.qualified_name, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM {sym} s LEFT JOIN (SELECT target_id, count(*) AS n FROM {multi} GROUP BY target_id) i ON i.target_id = s.node_id LEFT JOIN (SELECT source_id, count(*) AS n FROM {multi} GROUP BY source_id) o ON o.source_id = s.node_id")
def symbol_degree(t, spark):
    return R.degrees(t("sym"), t("multi"))


@query("SELECT target_id AS node_id, count(*) AS callers FROM {multi} GROUP BY target_id ORDER BY callers DESC, node_id LIMIT 10")
def hubs(t, spark):
    return R.hubs(t("multi"))


@query("SELECT regexp_extract(path, '^/proj/([^/]+)/', 1) AS folder, count(DISTINCT path) AS files FROM {sym} GROUP BY 1")
def module_structure(t, spark):
    return R.module_structure(t("sym"), "/proj")


@query("SELECT (SELECT count(*) FROM {sym}) AS nodes, (SELECT count(*) FROM {multi} WHERE lower(edge_type) = 'calls') AS edges")
def graph_counts(t, spark):
    known = t("multi").where("lower(edge_type) = 'calls'")
    both = t("sym").select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(known.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


RESOLVED = """WITH r AS (SELECT c.site, c.path, c.callee, CASE WHEN q.qualified_name IS NOT NULL THEN 'ImportMap' WHEN f.qualified_name IS NOT NULL THEN 'SameFile' WHEN u.qualified_name IS NOT NULL THEN 'GlobalUnique' ELSE 'Unresolved' END AS strategy,
  coalesce(q.qualified_name, f.qualified_name, u.qualified_name) AS target_qualified FROM {callsite} c
  LEFT JOIN {impmap} m ON m.path = c.path AND m.local_name = c.callee
  LEFT JOIN (SELECT DISTINCT qualified_name FROM {registry}) q ON q.qualified_name = concat(m.module_path, '.', c.callee)
  LEFT JOIN (SELECT path, name, min(qualified_name) AS qualified_name FROM {registry} GROUP BY path, name) f ON f.path = c.path AND f.name = c.callee
  LEFT JOIN (SELECT name, min(qualified_name) AS qualified_name FROM {registry} GROUP BY name HAVING count(DISTINCT qualified_name) = 1) u ON u.name = c.callee)"""


def resolved(t):
    return V.resolve_calls(t("callsite").select("site", "path", "callee"), t("impmap"), t("registry"))


@query(RESOLVED + " SELECT site, path, callee, target_qualified, strategy, CASE strategy WHEN 'ImportMap' THEN 0.95 WHEN 'SameFile' THEN 0.85 WHEN 'GlobalUnique' THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM r")
def resolve_calls(t, spark):
    return resolved(t).select("site", "path", "callee", "target_qualified", "strategy", "confidence")


@query(RESOLVED + " SELECT strategy, count(*) AS n FROM r GROUP BY strategy")
def resolution_strategies(t, spark):
    return resolved(t).groupBy("strategy").agg(F.count("*").alias("n"))


@query(RESOLVED + " SELECT count(*) AS calls, count(*) FILTER (strategy <> 'Unresolved') AS resolved, count(*) FILTER (strategy = 'Unresolved') AS unresolved FROM r")
def resolution_totals(t, spark):
    return resolved(t).agg(F.count("*").alias("calls"), F.count_if(F.col("strategy") != "Unresolved").alias("resolved"), F.count_if(F.col("strategy") == "Unresolved").alias("unresolved"))


@query("SELECT name, min(qualified_name) AS qualified_name FROM {sym} GROUP BY name HAVING count(*) = 1")
def global_unique(t, spark):
    return V.unique_names(t("sym"))


@query("SELECT qualified_name, max(node_id) AS node_id FROM {sym} GROUP BY qualified_name")
def registry_latest(t, spark):
    return V.latest(t("sym")).select("qualified_name", "node_id")


#: The cascade over callees with prefixes: an alias of a module, a class in it, and paths with ``::``.
PREFIXED = """WITH c AS MATERIALIZED (SELECT *, contains(callee, '::') AS rust, CASE WHEN contains(callee, '::') THEN regexp_extract(callee, '^(.*)::(.*?)$', 1) WHEN contains(callee, '.') THEN regexp_extract(callee, '^(.*)\\.(.*?)$', 1) END AS prefix,
    CASE WHEN contains(callee, '::') THEN regexp_extract(callee, '^(.*)::(.*?)$', 2) WHEN contains(callee, '.') THEN regexp_extract(callee, '^(.*)\\.(.*?)$', 2) ELSE callee END AS suffix FROM {sites}),
  p AS (SELECT *, split_part(prefix, '.', 1) AS head, CASE WHEN contains(prefix, '.') THEN substr(prefix, length(split_part(prefix, '.', 1)) + 2) END AS rest FROM c),
  q AS MATERIALIZED (SELECT qualified_name, max(node_id) AS node_id, min(name) AS name, min(path) AS path FROM {boxed} GROUP BY qualified_name),
  f AS MATERIALIZED (SELECT path, name, count(*) AS n, min_by(qualified_name, node_id) AS qualified_name FROM q GROUP BY path, name),
  u AS (SELECT name, min(qualified_name) AS qualified_name FROM q GROUP BY name HAVING count(*) = 1),
  m AS MATERIALIZED (SELECT path, local_name, min(module_path) AS module_path FROM {aliases} GROUP BY path, local_name),
  r AS MATERIALIZED (SELECT p.*, q1.qualified_name AS t1, c1.qualified_name AS k1, q2.qualified_name AS t2, q3.qualified_name AS t3, c2.qualified_name AS k2, f.qualified_name AS same, u.qualified_name AS alone FROM p
    LEFT JOIN m fm ON fm.path = p.path AND fm.local_name = coalesce(p.prefix, p.callee) LEFT JOIN m hm ON hm.path = p.path AND hm.local_name = p.head
    LEFT JOIN q q1 ON q1.qualified_name = concat(fm.module_path, '.', p.suffix) AND fm.module_path IS NOT NULL
    LEFT JOIN q q2 ON q2.qualified_name = concat(hm.module_path, '.', p.suffix) AND hm.module_path IS NOT NULL
    LEFT JOIN q q3 ON q3.qualified_name = concat_ws('.', hm.module_path, p.rest, p.suffix) AND hm.module_path IS NOT NULL
    LEFT JOIN f c1 ON c1.path = fm.module_path AND c1.name = p.suffix AND c1.n = 1 AND p.prefix IS NOT NULL LEFT JOIN f c2 ON c2.path = hm.module_path AND c2.name = p.suffix AND c2.n = 1 AND p.prefix IS NOT NULL
    LEFT JOIN f ON f.path = p.path AND f.name = p.suffix LEFT JOIN u ON u.name = p.suffix AND (p.prefix IS NULL OR p.rust)),
  s AS MATERIALIZED (SELECT site, path, callee, line, caller_qualified, coalesce(t1, k1, t2, t3, k2, same, alone) AS target_qualified,
    CASE WHEN coalesce(t1, k1, t2, t3, k2) IS NOT NULL THEN 'ImportMap' WHEN same IS NOT NULL THEN 'SameFile' WHEN alone IS NOT NULL THEN 'GlobalUnique' ELSE 'Unresolved' END AS strategy,
    CAST(CASE WHEN t1 IS NOT NULL THEN 0.95 WHEN k1 IS NOT NULL THEN 0.855 WHEN coalesce(t2, t3) IS NOT NULL THEN 0.95 WHEN k2 IS NOT NULL THEN 0.855 WHEN same IS NOT NULL THEN 0.85 WHEN alone IS NOT NULL THEN 0.9 ELSE 0 END AS DOUBLE) AS confidence FROM r)"""


def prefixed(t):
    return V.resolve_calls(t("sites"), t("aliases"), t("boxed"))


@query(PREFIXED + " SELECT site, callee, target_qualified, strategy, round(confidence, 6) AS confidence FROM s")
def resolve_prefixed(t, spark):
    return prefixed(t).select("site", "callee", "target_qualified", "strategy", F.round("confidence", 6).alias("confidence"))


@query(PREFIXED + ", ids AS (SELECT qualified_name, max(node_id) AS node_id FROM {boxed} GROUP BY qualified_name) SELECT a.node_id AS source_id, b.node_id AS target_id, 'calls' AS edge_type, s.path, s.line, round(max(confidence), 6) AS confidence FROM s JOIN ids a ON a.qualified_name = s.caller_qualified JOIN ids b ON b.qualified_name = s.target_qualified GROUP BY ALL")
def call_edges(t, spark):
    return R.dedup_edges(V.call_edges(prefixed(t), t("boxed"))).drop("metadata").withColumn("confidence", F.round("confidence", 6))


@query("SELECT site, CASE WHEN site % 3 = 0 THEN module || '.x' WHEN site % 3 = 1 THEN module END AS prefix, callee AS suffix, site % 3 = 1 AS rust FROM {callsite}")
def split_callee(t, spark):
    text = F.when(F.col("site") % 3 == 0, F.concat("module", F.lit(".x."), "callee")).when(F.col("site") % 3 == 1, F.concat("module", F.lit("::"), "callee")).otherwise(F.col("callee"))
    return t("callsite").select("site", X.split_callee(text).alias("s")).select("site", "s.prefix", "s.suffix", "s.rust")


# --- graph -------------------------------------------------------------------------------------------------


@query(levels_sql("SELECT 42 AS node_id", 10, True) + " SELECT node_id, depth, round(confidence, 6) AS confidence, round(confidence / depth, 6) AS risk FROM reached")
def impact_radius(t, spark):
    out = G.impact_radius(t("edg"), seeds(spark, 42))
    return out.select("node_id", "depth", F.round("confidence", 6).alias("confidence"), F.round("risk", 6).alias("risk"))


@query(levels_sql("SELECT 42 AS node_id", 10, True) + " SELECT depth, count(*) AS n_nodes, round(max(confidence / depth), 6) AS max_risk FROM reached GROUP BY depth")
def impact_by_depth(t, spark):
    return G.impact_by_depth(G.impact_radius(t("edg"), seeds(spark, 42))).withColumn("max_risk", F.round("max_risk", 6))


@query(levels_sql("SELECT 42 AS node_id", 20, False) + " SELECT node_id, depth, round(confidence, 6) AS confidence FROM reached")
def forward_reachable(t, spark):
    return G.reach(t("edg"), seeds(spark, 42), 20).select("node_id", "depth", F.round("confidence", 6).alias("confidence"))


@query(levels_sql("SELECT 77 AS node_id", 20, True) + " SELECT node_id, depth, round(confidence, 6) AS confidence FROM reached")
def reverse_reachable(t, spark):
    return G.reach(t("edg"), seeds(spark, 77), 20, reverse=True).select("node_id", "depth", F.round("confidence", 6).alias("confidence"))


@query(levels_sql("SELECT 7 AS node_id", 20, True) + " SELECT r.node_id, s.qualified_name, r.depth FROM reached r JOIN {sym} s USING (node_id)")
def callers_transitive(t, spark):
    return G.reach(t("edg"), seeds(spark, 7), 20, reverse=True).join(t("sym"), "node_id").select("node_id", "qualified_name", "depth")


@query(levels_sql("SELECT 7 AS node_id", 20, False) + " SELECT r.node_id, s.qualified_name, r.depth FROM reached r JOIN {sym} s USING (node_id)")
def callees_transitive(t, spark):
    return G.reach(t("edg"), seeds(spark, 7), 20).join(t("sym"), "node_id").select("node_id", "qualified_name", "depth")


PATH = levels_sql("SELECT 42 AS node_id", 20, False)
# From the end backwards, of the nodes before each the least: as many steps as the target is deep.
STEPS = ["b0 AS MATERIALIZED (SELECT node_id, depth FROM reached WHERE node_id = 77)"] + [
    f"b{k} AS MATERIALIZED (SELECT min(p.node_id) AS node_id, min(p.depth) AS depth FROM b{k - 1} q JOIN adj ON adj.b = q.node_id JOIN (SELECT node_id, depth FROM reached UNION ALL SELECT 42, 0) p ON p.node_id = adj.a AND p.depth = q.depth - 1 HAVING min(p.node_id) IS NOT NULL)" for k in range(1, 21)
]


@query(f"{PATH}, {', '.join(STEPS)} SELECT CAST(depth AS INT) AS hop, node_id FROM ({' UNION ALL '.join(f'SELECT * FROM b{k}' for k in range(21))}) z")
def call_path(t, spark):
    return G.call_path(t("edg"), 42, 77).select("hop", "node_id")


@query("SELECT a, b, round(max(w), 6) AS weight FROM (SELECT source_id AS a, target_id AS b, greatest(confidence, 0) AS w FROM {edg} UNION ALL SELECT target_id, source_id, greatest(confidence, 0) FROM {edg}) s GROUP BY a, b")
def sym_adjacency(t, spark):
    return C.symmetrised(t("edg")).withColumn("weight", F.round("weight", 6))


ADJ = "WITH adj AS (SELECT a, b, max(w) AS w FROM (SELECT source_id AS a, target_id AS b, confidence AS w FROM {edg} UNION ALL SELECT target_id, source_id, confidence FROM {edg}) s GROUP BY a, b), lab AS (SELECT adj.*, x.module AS ca, y.module AS cb FROM adj JOIN {sym} x ON x.node_id = a JOIN {sym} y ON y.node_id = b)"


def labels(t):
    return t("sym").select("node_id", F.col("module").alias("community"))


@query(ADJ + " SELECT ca AS a, cb AS b, round(sum(w), 6) AS weight FROM lab GROUP BY ca, cb")
def community_contract(t, spark):
    return C.contract(C.symmetrised(t("edg")), labels(t)).withColumn("weight", F.round("weight", 6))


@query(ADJ + ", per AS (SELECT ca, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS inside, sum(w) AS total FROM lab GROUP BY ca) SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity FROM per")
def modularity(t, spark):
    return C.modularity(C.symmetrised(t("edg")), labels(t)).select(F.round("modularity", 6).alias("modularity"))


@query(ADJ + ", deg AS (SELECT s.node_id, s.module, round(coalesce(sum(w), 0), 6) AS d FROM {sym} s LEFT JOIN adj ON a = s.node_id GROUP BY s.node_id, s.module), rep AS (SELECT module, node_id FROM deg QUALIFY row_number() OVER (PARTITION BY module ORDER BY d DESC, node_id) = 1) SELECT deg.module AS community, count(*) AS n_members, min(rep.node_id) AS representative, round(min(i.inside), 4) AS internal, round(min(i.outside), 4) AS external FROM deg JOIN rep USING (module) JOIN (SELECT ca, sum(CASE WHEN ca = cb THEN w ELSE 0 END) / 2 AS inside, sum(CASE WHEN ca <> cb THEN w ELSE 0 END) AS outside FROM lab GROUP BY ca) i ON i.ca = deg.module GROUP BY deg.module")
def community_summary(t, spark):
    out = C.summary(C.symmetrised(t("edg")), labels(t))
    return out.select("community", "n_members", "representative", F.round("internal", 4).alias("internal"), F.round("external", 4).alias("external"))


@query()
def communities(t, spark):
    return C.detect(t("sym"), t("sparse"))


@query("SELECT o_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS level FROM {orders}")
def topo_levels(t, spark):
    return G.topo_levels(t("imp"), t("orders").select(F.col("o_orderkey").alias("file_id")))


@query("SELECT i.file_id, i.needs FROM {imp} i JOIN {orders} a ON a.o_orderkey = i.file_id JOIN {orders} b ON b.o_orderkey = i.needs")
def import_deps(t, spark):
    files = t("orders").select(F.col("o_orderkey").alias("file_id"))
    inside = t("imp").join(files, "file_id", "left_semi")
    return inside.join(files.withColumnRenamed("file_id", "needs"), "needs", "left_semi").select("file_id", "needs")


@query("SELECT o_orderkey AS file_id FROM (SELECT o_orderkey, max(o_orderkey % 100 = 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hit FROM {orders}) s WHERE hit")
def changed_closure(t, spark):
    edges = t("imp").select(F.col("file_id").alias("importer_file_id"), F.col("needs").alias("imported_file_id"))
    return G.closure(edges, t("orders").where("o_orderkey % 100 = 3").select(F.col("o_orderkey").alias("file_id")))


CHANGED = "SELECT node_id FROM {sym} WHERE path IN (SELECT path FROM {sym} WHERE node_id IN (5, 42))"
IMPACT = levels_sql(CHANGED, 5, True) + f", impact AS (SELECT s.node_id, s.qualified_name, count(r.node_id) AS impacted, CASE WHEN count(r.node_id) > 20 THEN 'HIGH' WHEN count(r.node_id) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM {{sym}} s LEFT JOIN reached r ON r.seed = s.node_id WHERE s.node_id IN ({CHANGED}) GROUP BY s.node_id, s.qualified_name)"


def impact_of_change(t):
    return G.change_impact(t("sym"), t("edg"), t("sym").where("node_id in (5, 42)").select("path"))


@query(IMPACT + " SELECT * FROM impact")
def git_impact(t, spark):
    return impact_of_change(t).select("node_id", "qualified_name", "impacted", "risk")


@query(IMPACT + " SELECT v.risk, count(impact.risk) AS symbols FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(risk) LEFT JOIN impact ON impact.risk = v.risk GROUP BY v.risk")
def risk_histogram(t, spark):
    return G.risk_histogram(impact_of_change(t))


ARCHITECTURE = """SELECT 'count' AS part, 'files' AS item, count(*) AS value FROM {doc_files} UNION ALL SELECT 'count', 'nodes', count(*) FROM {sym} UNION ALL SELECT 'count', 'edges', count(*) FROM {edg} UNION ALL SELECT 'count', 'import_edges', count(*) FROM {imp}
  UNION ALL SELECT 'folder', regexp_extract(path, '^/proj/([^/]+)/', 1), count(DISTINCT path) FROM {sym} GROUP BY 2 UNION ALL SELECT 'hub', CAST(target_id AS STRING), n FROM (SELECT target_id, count(*) AS n FROM {multi} GROUP BY target_id ORDER BY n DESC, target_id LIMIT 10) h
  UNION ALL SELECT 'language', language, count(*) FROM {doc_files} GROUP BY language
  UNION ALL SELECT 'entry', qualified_name, 1 FROM (SELECT * FROM {sym} WHERE name = 'main' OR (is_exported AND kind = 'function' AND NOT regexp_matches(name, '^(test_|bench_)')) ORDER BY path, line_start, node_id LIMIT 20) e
  UNION ALL SELECT 'entry_total', 'all', count(*) FROM {sym} WHERE name = 'main' OR (is_exported AND kind = 'function' AND NOT regexp_matches(name, '^(test_|bench_)'))"""


@query(ARCHITECTURE)
def architecture(t, spark):
    """Counts, folders, hubs, languages and entry points; ``architecture_communities`` is the fifth part."""
    counts = R.index_status(t("doc_files"), t("sym"), t("edg"), t("imp")).select(F.lit("count").alias("part"), F.col("metric").alias("item"), "value")
    folders = R.module_structure(t("sym"), "/proj").select(F.lit("folder").alias("part"), F.col("folder").alias("item"), F.col("files").alias("value"))
    top = R.hubs(t("multi")).select(F.lit("hub").alias("part"), F.col("node_id").cast("string").alias("item"), F.col("callers").alias("value"))
    langs = t("doc_files").groupBy("language").agg(F.count("*").alias("value")).select(F.lit("language").alias("part"), F.col("language").alias("item"), "value")
    entries = R.entry_points(t("sym")).select(F.lit("entry").alias("part"), F.col("qualified_name").alias("item"), F.lit(1).cast("long").alias("value"))
    total = R.all_entry_points(t("sym")).agg(F.count("*").alias("value")).select(F.lit("entry_total").alias("part"), F.lit("all").alias("item"), "value")
    return counts.unionByName(folders).unionByName(top).unionByName(langs).unionByName(entries).unionByName(total)


@query()
def architecture_communities(t, spark):
    """The sizes of the communities of the sparse graph and the largest ones."""
    adjacency = cut(C.symmetrised(t("sparse")))
    found = cut(C.summary(adjacency, C.detect_in(t("sym"), adjacency)))
    groups = C.ranked(C.largest(found)).select(F.lit("community").alias("part"), F.col("community").cast("string").alias("item"), F.col("n_members").alias("value"))
    return groups.unionByName(C.sizes(found).select(F.lit("count").alias("part"), "item", "value"))


@query("SELECT node_id, CAST(dense_rank() OVER (ORDER BY module) - 1 AS BIGINT) AS community FROM {sym}")
def compact_labels(t, spark):
    return C.compact(labels(t)).select("node_id", "community")


# --- changes -------------------------------------------------------------------------------------------------


@query("SELECT path, count(*) AS n_events, count(*) FILTER (kind = 'remove') AS n_removed FROM {changes} GROUP BY path")
def change_stream(t, spark):
    return H.stream_counts(t("changes"))


@query("WITH g AS (SELECT path, ts, kind, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {changes} WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT path, epoch_us(min(ts)) AS started, count(*) AS n_events, bool_or(kind = 'remove') AS removed FROM s GROUP BY path, k")
def change_sessions(t, spark):
    return H.sessions(t("changes"), "6 hours").select("path", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), "n_events", "removed")


@query("SELECT event_id, path, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM {changes}) s WHERE before IS NULL OR before <> content_hash")
def hash_dedup(t, spark):
    return H.dedup(t("changes")).select("event_id", "path", "content_hash")


@query("SELECT event_id, path, kind FROM {changes} WHERE kind <> 'remove' OR path IN (SELECT path FROM {changes} WHERE kind = 'create')")
def change_filter(t, spark):
    indexed = t("changes").where("kind = 'create'").select("path").distinct()
    return H.keep_known(t("changes"), indexed).select("event_id", "path", "kind")


@query("SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM {changes}) s WHERE r = 1 AND kind <> 'remove'")
def apply_changes(t, spark):
    return H.current(t("changes")).select("path", "content_hash")
