"""The catalogue against SQL, and the engine over a small project."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.functions.text import glob_regex, glob_suffix, module_file
from codeloom.operators import communities, search
from codeloom.plans import catalog, lineage

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def plain(df):
    """Rows as sorted tuples of text; integers that a null has made floats read as integers."""

    def cell(v):
        if pd.isna(v):
            return "~"
        return str(v) if isinstance(v, str | bool) or type(v).__name__ == "bool_" else f"{float(v):.9g}"

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["impact_radius", "dead_code", "symbol_search", "resolve_calls", "git_impact", "dedup_edges", "delete_cascade", "topo_levels", "change_sessions", "modularity"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got) == sorted(want) and plain(got) == plain(want)


FILES = [
    ("/p/till.ts", "typescript", "import { total } from './cart';\nimport { print as show } from './paper';\n\nexport function close() {\n  total([3, 4]);\n  show();\n  queue.flush();\n}\n"),
    ("/p/cart.ts", "typescript", "export function total(prices: number[]) {\n  if (prices && prices.length) { return prices[0]; }\n  return 0;\n}\n"),
    ("/p/paper.ts", "typescript", "export function print() {\n  return feed();\n}\nfunction feed() {\n  return 7;\n}\nfunction forgotten() {\n  return 2;\n}\n"),
    ("/p/stock.py", "python", "from .scan import read\n\nclass Stock:\n    def count(self):\n        return read(1)\n"),
    ("/p/scan.py", "python", "def read(x):\n    return x if x else 0\n"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, "/p").index(spark.createDataFrame(FILES, "path string, language string, content string"))


def test_project(engine):
    names = {r["qualified_name"] for r in engine.nodes.collect()}
    assert names == {"/p/till.ts.close", "/p/cart.ts.total", "/p/paper.ts.print", "/p/paper.ts.feed", "/p/paper.ts.forgotten", "/p/stock.py.Stock", "/p/stock.py.Stock.count", "/p/scan.py.read"}
    strategies = {(r["callee"], r["strategy"]) for r in engine.calls.collect()}
    assert {("total", "ImportMap"), ("feed", "SameFile"), ("read", "ImportMap"), ("queue.flush", "Unresolved")} <= strategies
    assert [r["name"] for r in engine.query("detect_dead_code").collect() if r["path"].endswith(".ts")] == ["forgotten"]
    assert engine.query("get_call_path", {"source": "stock.py.Stock.count", "target": "scan.py.read"}).count() == 2
    assert {r["name"] for r in engine.query("get_impact_radius", {"source": "cart.ts.total"}).collect()} == {"close"}
    assert engine.query("find_definition", {"caller_qualified_name": "till.ts.close", "call_line": "5"}).first()["definition"] == "/p/cart.ts.total"
    assert engine.query("search_symbols", {"query": "tot"}).first()["name"] == "total"
    assert engine.query("search_code", {"pattern": "return", "file_glob": "cart.ts"}).count() == 2
    assert engine.query("get_symbol", {"qualified_name": "cart.ts.total"}).first()["callers"] == 1
    with pytest.raises(ValueError):
        engine.query("nothing")
    with pytest.raises(ValueError, match="invalid pattern"):
        engine.query("search_code", {"pattern": "("})


def test_other_tools(engine):
    callers = engine.query("get_callers", {"source": "scan.py.read"}).collect()
    assert [(r["qualified_name"], r["file"], r["line"], r["depth"], r["confidence"]) for r in callers] == [("/p/stock.py.Stock.count", "/p/stock.py", 5, 1, 0.95)]
    assert [(r["name"], r["line"]) for r in engine.query("get_callees", {"source": "till.ts.close"}).collect()] == [("total", 5)]
    assert [r["name"] for r in engine.query("get_file_outline", {"file_path": "./sub/../paper.ts"}).collect()] == ["print", "feed", "forgotten"]
    assert [r["caller"] for r in engine.query("find_references", {"qualified_name": "/p/scan.py.read"}).collect()] == ["/p/stock.py.Stock.count"]
    status = {r["metric"]: (r["value"], r["text"]) for r in engine.query("get_index_status").collect()}
    assert status["files"] == (5, None) and status["nodes"] == (8, None) and status["import_edges"] == (3, None) and status["root"] == (None, "/p")
    impact = {r["qualified_name"]: (r["impacted"], r["risk"]) for r in engine.query("get_git_impact", {"paths": ["scan.py", "cart.ts"]}).collect()}
    assert impact == {"/p/scan.py.read": (1, "LOW"), "/p/cart.ts.total": (1, "LOW")}
    groups = engine.query("get_communities").collect()
    assert [r["ordinal"] for r in groups] == list(range(1, len(groups) + 1)) and all(r["n_members"] == len(r["members"]) > 1 for r in groups)


def test_names():
    assert glob_suffix("src/**/*.rs") == ".rs" and glob_suffix("**/*.py") == ".py"
    assert glob_regex("*.log") == r"(?:^|/)[^/]*\.log(?:/|$)"


def test_module_files(spark):
    cases = [
        ("/p/a/b.ts", "../c", "/p/c.ts"), ("/p/b.ts", "lodash", "lodash"), ("/p/a/b.tsx", "./d/./e", "/p/a/d/e.tsx"), ("/p/a/b.ts", "./x.json", "/p/a/x.json"), ("/p/a/b.py", "./m", "/p/a/m.py"),
        ("/p/b.js", "../../up", "/up.js"), ("/p/b.jsx", "./.hidden", "/p/.hidden.jsx"), ("/p/b.hpp", "./shape", "/p/shape.cpp"),
    ]
    rows = spark.createDataFrame(cases, "importer string, module string, want string").select("want", module_file(F.col("importer"), F.col("module")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@pytest.mark.parametrize("local", [0, 1000])
def test_communities_settle(spark, local):
    # A chain of cliques, with a hub over one member of each: gains are left after few rounds.
    pairs = [(5 * c + i, 5 * c + j) for c in range(6) for i in range(5) for j in range(i)] + [(5 * c, 5 * c - 1) for c in range(1, 6)] + [(100, 5 * c) for c in range(6)] + [(200 + i, 201 + i) for i in range(30)]
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    nodes, m2 = sorted(adj), 2 * len(pairs)

    def quality(label):
        return sum(label[a] == label[b] for a in adj for b in adj[a]) / m2 - sum(sum(len(adj[v]) for v in nodes if label[v] == c) ** 2 for c in set(label.values())) / m2**2

    def best(label, v):
        worth = lambda c: sum(label[u] == c for u in adj[v]) - len(adj[v]) * sum(len(adj[u]) for u in nodes if label[u] == c and u != v) / m2
        return max(worth(c) for c in {label[u] for u in adj[v]}) - worth(label[v])

    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source_id long, target_id long, confidence double")
    flat = {r["node_id"]: r["community"] for r in communities.settle(communities.symmetrised(edges), float(m2), local=local).collect()}
    assert sorted(flat) == nodes and all(best(flat, v) <= 1e-6 for v in nodes)
    found = {r["node_id"]: r["community"] for r in communities.detect(spark.createDataFrame([(v,) for v in [*nodes, 999]], "node_id long"), edges, local=local).collect()}
    assert sorted(found) == [*nodes, 999] and found.pop(999) == 999
    assert all(c == min(v for v in found if found[v] == c) for c in found.values())
    # The greedy sequential result: one local phase, nodes in order, until none gains.
    greedy, moved = {v: v for v in nodes}, True
    while moved:
        moved = False
        for v in nodes:
            worth = {c: sum(greedy[u] == c for u in adj[v]) - len(adj[v]) * sum(len(adj[u]) for u in nodes if greedy[u] == c and u != v) / m2 for c in {greedy[u] for u in adj[v]} | {greedy[v]}}
            to = max(worth, key=worth.get)
            if worth[to] > worth[greedy[v]] + 1e-9:
                greedy[v], moved = to, True
    assert quality(found) >= quality(flat) - 1e-9 and quality(found) >= quality(greedy) - 0.02


def test_communities_of_a_million_edges(spark):
    # Triangles: more entries than one task took before, which then needed a table for each of many rounds.
    corner = [(F.col("id") * 3 + i).alias(n) for i, n in enumerate("xyz")]
    ways = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ("xy", "yx", "xz", "zx", "yz", "zy")])).alias("way")
    graph = lineage.cut(spark.range(200_000).select(*corner).select(ways).select("way.*", F.lit(1.0).alias("weight")))
    before = len(lineage._written)
    labels = communities.settle(graph, 1_200_000.0)
    assert len(lineage._written) == before + 1
    assert labels.count() == 600_000 and labels.where("community <> node_id - node_id % 3 + 1").isEmpty()


def test_communities_read_edges_once(spark):
    t, _ = frames(spark)
    edges = t("edg").join(t("edg").select("source_id").distinct(), "source_id")
    assert communities.symmetrised(edges)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def frames(spark):
    """A chain of 30 calls through 7, 42 and 77, with its symbols."""
    chain = [*range(100, 108), 7, *range(108, 119), 42, *range(119, 123), 77, *range(123, 128)]
    found = {
        "edg": spark.createDataFrame([(a, b, 0.5) for a, b in zip(chain, chain[1:], strict=False)], "source_id long, target_id long, confidence double"),
        "sym": spark.createDataFrame([(v, f"f{v}", f"q.f{v}", f"/p/{v}.ts", 1, 9) for v in chain], "node_id long, name string, qualified_name string, path string, line_start int, line_end int"),
        "orders": spark.createDataFrame([(i,) for i in range(6)], "o_orderkey long"),
        "imp": spark.createDataFrame([(i + 1, i) for i in range(6)], "file_id long, needs long"),
        "crlf": spark.createDataFrame([("/p/7.ts", "a 123\nb"), ("/p/x.ts", "c 456")], "path string, content string"),
    }
    found["lined"] = found["sym"]
    return found.__getitem__, chain


def test_search_meets_symbols_by_equal_keys(spark):
    assert "NestedLoop" not in catalog.view(spark, DATA, "lined")._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([("/p/x.ts", "\t 123\f\r\r\n456\u2028\n\n")], "path string, content string")
    assert [r["line"] for r in search.lines_of(files).orderBy("line_no").collect()] == ["\t 123\f\r", "456\u2028", ""]
    none = spark.createDataFrame([], "path string, name string, line_start int, line_end int, node_id long")
    assert {r["line"] for r in search.search_code(files, "[0-9]", none).collect()} == {"123", "456\u2028"}


def test_whole_depths(spark):
    t, chain = frames(spark)
    at = chain.index
    got = {r["node_id"]: r["depth"] for r in catalog.callees_transitive(t, spark).collect()}
    assert got == {v: at(v) - at(7) for v in chain if 0 < at(v) - at(7) <= 20}
    assert catalog.call_path(t, spark).agg(F.max("hop")).first()[0] == 5
    impact = {r["node_id"]: r["depth"] for r in catalog.impact_radius(t, spark).collect()}
    assert impact == {v: at(42) - at(v) for v in chain if 0 < at(42) - at(v) <= 10}
    assert {r["node_id"]: (r["impacted"], r["risk"]) for r in catalog.git_impact(t, spark).collect()} == {42: (5, "MEDIUM")}


def test_no_rows_are_left_out(spark):
    t, chain = frames(spark)
    assert sorted(tuple(r) for r in catalog.import_deps(t, spark).collect()) == [(i + 1, i) for i in range(5)]
    assert sorted(tuple(r) for r in catalog.reverse_deps(t, spark).collect()) == [(i, i + 1) for i in range(6)]
    assert {r["symbol"] for r in catalog.enclosing_symbol(t, spark).collect()} == {f"f{v}" for v in chain}
    assert {(r["path"], r["symbol"]) for r in catalog.search_code(t, spark).collect()} == {("/p/7.ts", "f7"), ("/p/x.ts", None)}


def test_architecture_communities_read_the_graph_once(spark):
    t, chain = frames(spark)
    asked = []

    def table(name):
        asked.append(name)
        return t({"sparse": "edg"}.get(name, name))

    rows = catalog.architecture_communities(table, spark).collect()
    assert sum(r["value"] for r in rows if r["part"] == "community") == len(chain) and sorted(asked) == ["sparse", "sym"]


def test_architecture_has_all_parts(engine):
    parts = {}
    for r in engine.query("get_architecture").collect():
        parts.setdefault(r["part"], {})[r["item"]] = r["value"]
    assert set(parts) == {"folder", "entry", "hub", "language", "count", "entry_total", "community"} and parts["count"]["communities"] >= len(parts["community"])
    assert parts["entry_total"]["all"] == len(parts["entry"]) and parts["count"]["files"] == len(FILES) and all(n > 1 for n in parts["community"].values())
