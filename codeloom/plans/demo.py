"""The domain's tables as views of the standard tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NEXT_ITEM = "{lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey"

VIEWS = {
    "sym": """SELECT node_id, kind, name, concat(path, '.', name) AS qualified_name, module, path, is_exported, complexity, line_start, CAST(line_start + 8 AS INT) AS line_end FROM (
        SELECT p_partkey AS node_id, CASE WHEN p_partkey % 7 = 0 THEN 'variable' WHEN p_partkey % 5 = 0 THEN 'class' WHEN p_partkey % 2 = 0 THEN 'method' ELSE 'function' END AS kind,
        concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 11 = 0 THEN concat('_', CAST(p_partkey AS STRING)) ELSE '' END) AS name, p_brand AS module,
        concat('/proj/', lower(p_type), '/', replace(p_brand, '#', '_'), '.ts') AS path, p_size % 3 = 0 AS is_exported, CAST(1 + p_size % 10 AS INT) AS complexity,
        CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) * 10 - 9 AS INT) AS line_start FROM {part}) s""",
    "edg": f"SELECT a.l_partkey AS source_id, b.l_partkey AS target_id, 'calls' AS edge_type, max(1 - a.l_discount) AS confidence FROM {NEXT_ITEM} WHERE a.l_returnflag = 'R' GROUP BY a.l_partkey, b.l_partkey",
    "sparse": f"SELECT a.l_partkey AS source_id, b.l_partkey AS target_id, max(1 - a.l_discount) AS confidence FROM {NEXT_ITEM} WHERE a.l_returnflag = 'R' AND a.l_discount <= 0.02 GROUP BY a.l_partkey, b.l_partkey",
    "multi": f"SELECT a.l_partkey AS source_id, b.l_partkey AS target_id, CASE WHEN a.l_suppkey % 10 = 0 THEN 'CALLS' WHEN a.l_suppkey % 10 = 1 THEN 'references' ELSE 'calls' END AS edge_type, 1 - a.l_discount AS confidence, CAST(a.l_linenumber AS INT) AS line, concat('/proj/o', CAST(a.l_orderkey % 97 AS STRING), '.ts') AS path FROM {NEXT_ITEM}",
    "nullable": f"SELECT a.l_partkey AS source_id, b.l_partkey AS target_id, 'calls' AS edge_type, 1 - a.l_discount AS confidence, CAST(a.l_linenumber AS INT) AS line, concat('/proj/o', CAST(a.l_orderkey % 97 AS STRING), '.ts') AS path FROM {NEXT_ITEM.replace(' JOIN ', ' LEFT JOIN ')}",
    "doc_files": "SELECT doc_id AS file_id, concat('/proj/', source, '/', CAST(doc_id AS STRING), '.', lang) AS path, lang AS language, md5(text) AS content_hash, n_chars AS size, text AS content FROM {documents}",
    "imp": "SELECT file_id, needs FROM (SELECT o_orderkey AS file_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS needs FROM {orders}) s WHERE needs IS NOT NULL",
    "callsite": "SELECT l.l_orderkey * 100 + l.l_linenumber AS site, concat('Brand#', CAST(l.l_suppkey % 25 + 1 AS STRING)) AS path, s.name AS callee, l.l_partkey AS pk, s.module FROM {lineitem} l JOIN {sym} s ON s.node_id = l.l_partkey",
    "impmap": "SELECT path, callee AS local_name, min(module) AS module_path FROM {callsite} c WHERE pk % 9 = 0 GROUP BY path, callee",
    "registry": "SELECT node_id, name, concat(module, '.', name) AS qualified_name, module AS path FROM {sym} s",
    "ctor": "SELECT node_id, kind, name, CASE WHEN node_id % 13 = 0 THEN concat(qualified_name, '.', name) ELSE qualified_name END AS qualified_name, path, is_exported, line_start FROM {sym} s",
    "crlf": "SELECT path, CASE file_id % 3 WHEN 0 THEN concat(replace(content, chr(10), concat(chr(13), chr(10))), chr(10)) WHEN 1 THEN concat(content, chr(10)) ELSE content END AS content FROM {doc_files} d",
    "lined": "SELECT f.path, s.node_id, s.name, CAST(1 + s.node_id % 7 AS INT) AS line_start, CAST(1 + s.node_id % 7 + s.node_id % 40 AS INT) AS line_end FROM {doc_files} f JOIN {sym} s ON s.node_id BETWEEN f.file_id AND f.file_id + 2",
    "boxed": "SELECT node_id, name, module AS path, CASE WHEN node_id % 3 = 0 THEN concat(module, '.Box.', name) ELSE concat(module, '.', name) END AS qualified_name FROM {sym} s",
    "aliases": "SELECT path, concat('m', CAST(pk % 9 AS STRING)) AS local_name, min(module) AS module_path FROM {callsite} c WHERE pk % 9 < 7 GROUP BY path, concat('m', CAST(pk % 9 AS STRING))",
    "sites": """SELECT site, path, line, caller_qualified, CASE site % 6 WHEN 0 THEN concat('m', CAST(pk % 9 AS STRING), '.', callee) WHEN 1 THEN concat('m', CAST(pk % 9 AS STRING), '.Box.', callee) WHEN 2 THEN concat('m', CAST(pk % 9 AS STRING), '::', callee)
        WHEN 3 THEN concat('zz.', callee) WHEN 4 THEN concat('zz::', callee) ELSE callee END AS callee FROM (SELECT c.site, c.path, c.callee, c.pk, CAST(c.site % 50 AS INT) AS line, b.caller_qualified FROM {callsite} c LEFT JOIN (SELECT path, min(qualified_name) AS caller_qualified FROM {boxed} GROUP BY path) b ON b.path = c.path) s""",
    # A file of code for each symbol, in five languages.
    "code": """SELECT node_id, name, node_id % 5 AS k, concat('/src/', CAST(node_id AS STRING), CASE node_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' WHEN 3 THEN '.go' ELSE '.java' END) AS path,
        CASE node_id % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' WHEN 3 THEN 'go' ELSE 'java' END AS language,
        replace(replace(replace(CASE node_id % 5 WHEN 0 THEN concat('import « @_dep as d » from "./dep";', n, '// @(1)', n, 'export function @(a: number): number «', n, '  if (a && d(a)) « return 1; »', n, '  return a;', n, '»', n)
          WHEN 1 THEN concat('from .dep import @_dep', n, n, 'def @(a) -> int:', n, '    return @_dep(a) if a else 0  # @(1)', n)
          WHEN 2 THEN concat('use dep::@_dep;', n, '/* @(1) */', n, 'pub fn @(a: i32) -> i32 «', n, '    match a « 0 => @_dep(a), _ => 1 »', n, '»', n)
          WHEN 3 THEN concat('package p', n, 'import d "x/dep"', n, 'func @(a int) int «', n, '  if a > 1 « return d.Run("@(1)", a) »', n, '  return 0', n, '»', n)
          ELSE concat('import x.Dep;', n, 'class C «', n, '  int @(int a) «', n, '    while (a > 1) « a = Dep.run(a); »', n, '    return a;', n, '  »', n, '»', n) END, '@', name), '«', chr(123)), '»', chr(125)) AS content FROM (SELECT node_id, name, chr(10) AS n FROM {sym}) s""",
    "changes": "SELECT event_id, user_id AS path, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'modify' END AS kind, md5(props) AS content_hash FROM {events}",
}

#: Views that Spark joins on equal keys; for the same rows by a range it would compare all with all.
EQUAL_KEYS = {
    "lined": VIEWS["lined"].replace("{doc_files} f JOIN {sym} s ON s.node_id BETWEEN f.file_id AND f.file_id + 2", "(SELECT path, explode(sequence(file_id, file_id + 2)) AS near FROM {doc_files} d) f JOIN {sym} s ON s.node_id = f.near"),
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = EQUAL_KEYS.get(name, VIEWS[name])
    return spark.sql(sql, **{k: view(spark, sf_dir, k) for k in needs(sql)})


def oracle(sql: str) -> str:
    """SQL for DuckDB: the views that ``sql`` names in braces become common table expressions before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in order)
    body = plain(sql)
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
