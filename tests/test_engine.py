"""Discovery, versions, and changes: an index after changes is the index of the changed project."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.functions.text import ascii_edges, branch_count
from codeloom.plans.lineage import new_path
from codeloom.sources.files import discover, keep_files, load_config, scan_files
from codeloom.streaming import changes as H

FILES = {
    "/q/a.ts": "import { price } from './b';\nimport { lone } from './c';\nexport function first() {\n  price();\n  lone();\n  far();\n}\n",
    "/q/b.ts": "export function price() {\n  return base();\n}\nfunction base() { return 1; }\n",
    "/q/c.ts": "export function lone() { return 3; }\n",
    "/q/d.ts": "export function far() { return 4; }\nexport function other() { far(); }\n",
    "/q/main.rs": "use shop::sell;\nfn main() { sell(1); shop::gone(2); }\n",
}
SCHEMA = "path string, language string, content string"


def frame(spark, files):
    language = lambda p: {"ts": "typescript", "rs": "rust", "py": "python"}[p.rsplit(".")[-1]]
    return spark.createDataFrame([(p, language(p), c) for p, c in files.items()], SCHEMA)


def tables(engine):
    """The rows of all tables that must not depend on how the index came to be."""
    rows = lambda df: sorted(map(str, df.collect()))
    return {
        "files": rows(engine.files.select("path", "language", "content", "file_id", F.hex("content_hash"))), "nodes": rows(engine.nodes.select(sorted(engine.nodes.columns))),
        "calls": rows(engine.calls.select(sorted(engine.calls.columns))), "edges": rows(engine.edges.select(sorted(engine.edges.columns))), "imports": rows(engine.imports),
        "import_edges": rows(engine.import_edges), "adjacency": rows(engine.adjacency), "postings": rows(engine.postings.select("node_id", "token", "tf", "length")), "statistics": rows(engine.statistics),
    }


def changes(spark, *rows):
    return spark.createDataFrame([(p, k, i, c) for i, (p, k, c) in enumerate(rows)], "path string, kind string, ts long, content string")


@pytest.fixture(scope="module")
def start(spark):
    return Engine(spark, "/q").index(frame(spark, FILES))


STEPS = [
    # A name that was unique is no longer, one is renamed, a line moves, a file comes that needs one that is not there.
    [("/q/c.ts", "modify", "\nexport function lone() { return 3; }\nexport function far() { return 5; }\n"), ("/q/b.ts", "modify", "export function cost() { return base(); }\nfunction base() { return 2; }\n"),
     ("/q/e.py", "create", "from .f import run\ndef go():\n    run()\n"), ("/q/shop.rs", "create", "pub fn sell(n: i32) {}\npub fn gone(n: i32) {}\n")],
    # Files that others import go, another comes that imports lead to; of two changes the last counts.
    [("/q/c.ts", "remove", None), ("/q/shop.rs", "remove", None), ("/q/unknown.ts", "remove", None), ("/q/f.py", "create", "def run():\n    pass\n"), ("/q/a.ts", "modify", "x"), ("/q/a.ts", "modify", FILES["/q/a.ts"]),
     ("/q/notes.txt", "create", "no source")],
]


def test_changes_make_the_index_of_the_changed_project(spark, start):
    engine, files = Engine(spark, "/q", start.store).open(), dict(FILES)
    for k, step in enumerate(STEPS):
        engine.apply(changes(spark, *step), k)
        for path, kind, content in step:
            if kind == "remove":
                files.pop(path, None)
            elif not path.endswith(".txt"):
                files[path] = content
        before = tables(engine)
        assert before == tables(Engine(spark, "/q").index(frame(spark, files))), k
    version = engine.version
    assert engine.apply(changes(spark, *STEPS[1]), 1).version == version, "a batch that comes again is not applied again"
    assert engine.apply(changes(spark, *STEPS[1])).version == version, "what is stored already changes nothing"
    assert tables(Engine(spark, "/q", engine.store).open()) == before


def test_versions_are_whole(spark):
    engine = Engine(spark, "/q").index(frame(spark, FILES))
    reader = Engine(spark, "/q", engine.store).open()
    engine.apply(changes(spark, ("/q/d.ts", "remove", None)))
    # Who opened the version before still reads it, who opens now reads the new one.
    assert reader.files.count() == 5 and reader.get_meta("root") == "/q" and Engine(spark, "/q", engine.store).open().files.count() == 4
    engine.set_meta("note", "one").set_meta("note", "two")
    assert engine.get_meta("note") == "two" and engine.get_meta("none") is None and engine.get_meta("root") == "/q"
    # Notes leave the other tables where they are; of tables that were replaced only the last ones before stay.
    kept = [f"{v}/{t}" for v in os.listdir(engine.store) if v.startswith("v-") for t in os.listdir(f"{engine.store}/{v}")]
    assert sum(x.endswith("/nodes") for x in kept) == 1 and sum(x.endswith("/meta") for x in kept) == 2
    assert engine.files.count() == 4 and not [x for x in os.listdir(engine.store) if x.startswith("current-")]
    with pytest.raises(FileNotFoundError):
        Engine(spark, "/q", new_path(spark, "nothing")).open()


def test_watching_a_stream(spark):
    engine = Engine(spark, "/q").index(frame(spark, FILES))
    folder = new_path(spark, "events")
    changes(spark, ("/q/d.ts", "remove", None), ("/q/g.ts", "create", "export function late() { lone(); }\n")).write.parquet(folder)
    source = spark.readStream.schema("path string, kind string, ts long, content string").parquet(folder)
    query = engine.watch(source, new_path(spark, "watch"))
    query.processAllAvailable()
    query.stop()
    files = {p: c for p, c in FILES.items() if p != "/q/d.ts"} | {"/q/g.ts": "export function late() { lone(); }\n"}
    assert tables(engine) == tables(Engine(spark, "/q").index(frame(spark, files)))


def test_dependents(spark, start):
    rows = [(r["path"], r["level"]) for r in Engine(spark, "/q").index(frame(spark, FILES)).dependents(["b.ts"]).collect()]
    assert rows == [("/q/b.ts", 0), ("/q/a.ts", 1)]


def test_sessions_of_a_stream(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = spark.createDataFrame([("a", 0.0, "create"), ("a", 0.1, "modify"), ("a", 0.2, "remove"), ("a", 9.0, "modify"), ("b", 0.1, "create"), ("z", 500.0, "create")], "path string, s double, kind string")
    rows = rows.withColumn("ts", (at.cast("double") + F.col("s")).cast("timestamp")).drop("s")
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    rows.write.parquet(folder)
    stream = H.sessions(spark.readStream.schema(rows.schema).parquet(folder), late="1 second")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    got = {(r["path"], r["n_events"], r["removed"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 3, True), ("a", 1, False), ("b", 1, False)}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_discovery(spark, tmp_path):
    write(tmp_path, {
        "a.ts": "function a() {}", "src/__init__.py": "def b(): pass", "src/_priv/c.py": "def c(): pass", "src/d.min.js": "x()", "src/gen/e.go": "package e", "src/gen/keep.go": "package k",
        "build/f.ts": "x", "build/g.ts": "x", ".hidden/h.ts": "x", ".i.ts": "x", "README.md": "x", "big.ts": "x" * 300, "bad.py": b"\xff\xfe", "sub/build.ts": "x", "sub/deep/j.rs": "x",
        ".gitignore": "# rules\nbuild/\n*.min.js\n!build/g.ts\n", "src/gen/.ignore": "*.go\n!keep.go\n", "sub/.gitignore": "/deep\n", "logs/k.ts": "x", "vendor/x/l.ts": "x",
    })
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    root = str(tmp_path)
    names = lambda **o: [p[len(root) + 1 :] for p, _ in discover(spark, root, max_size=200, **o)]
    assert names(ignore=["logs", "**/x/**"]) == ["a.ts", "bad.py", "src/__init__.py", "src/_priv/c.py", "src/gen/keep.go", "sub/build.ts"]
    assert "link.ts" in names(follow_symlinks=True) and "linked/build.ts" in names(follow_symlinks=True)
    rows = {r["path"][len(root) + 1 :]: r for r in scan_files(spark, root, max_size=200, ignore=["logs/", "vendor"]).collect()}
    assert set(rows) == {"a.ts", "src/__init__.py", "src/_priv/c.py", "src/gen/keep.go", "sub/build.ts"} and rows["src/__init__.py"]["content"] == "def b(): pass" and rows["a.ts"]["language"] == "typescript"


def test_project_with_configuration(spark, tmp_path):
    write(tmp_path, {"codeloom.toml": 'max_file_size = 100\nignore = ["skip"]\n', "a.ts": "export function a() { b(); }\nfunction b() {}\n", "skip/c.ts": "x()", "big.ts": "x();" * 99, "_d.py": "def d():\n    d()\n"})
    assert load_config("")["follow_symlinks"] is False and load_config("ignore = ['x']")["max_file_size"] == 1 << 20
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "start")
    (tmp_path / "a.ts").write_text("export function a() { b(); }\nfunction b() { }\n")
    engine = Engine(spark)
    assert tuple(engine.query("index_project", {"project_root": str(tmp_path)}).first()) == (2, 2, 0)
    assert {r["path"].rsplit("/", 1)[1] for r in engine.files.collect()} == {"a.ts", "_d.py"}
    assert {r["qualified_name"].rsplit(".", 1)[1]: r["impacted"] for r in engine.query("get_git_impact").collect()} == {"a": 0, "b": 1}


def test_keep_files_takes_back(spark):
    files = spark.createDataFrame([("/r/gen/a.ts", 1), ("/r/gen/b.ts", 1), ("/r/c.ts", 9)], "path string, size long")
    assert [r["path"] for r in keep_files(files, root="/r", ignore=["gen/", "!gen/b.ts"], max_size=5).collect()] == ["/r/gen/b.ts"]
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    fresh = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, content_hash string")
    assert sorted(r["path"] for r in H.dedup_against(fresh, stored).collect()) == ["b", "c"]


def test_word_edges_are_ascii(spark):
    cases = [("ment\u00eade the\u00e9 de.", 4), ("tion the_de de", 3), ("a\u0301the b", 2), ("", 1), (None, None)]
    rows = spark.createDataFrame(cases, "text string, want int").select("want", branch_count(F.col("text"), r"tion|\bthe\b|\bde\b").alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert ascii_edges(r"\\b\d") == r"\\b\d"
