"""The query façade: index a project once, then ask by tool name; every answer is a DataFrame.

The tables of an index are one version: folders that are written whole before a pointer moves to them, so that readers see all of
a change or nothing of it. Changes make the next version from the files that changed and what depends on them.
"""

from __future__ import annotations

import json
import logging
import os
import posixpath
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.text import glob_suffix, language_of, module_file, rust_candidates
from codeloom.operators import communities, graph, relational, resolve, search
from codeloom.plans.lineage import cut, delete_path, new_path
from codeloom.sources import frontends
from codeloom.sources.files import CONFIG, load_config, read_bytes, scan_files
from codeloom.streaming import changes as H

TABLES = ("files", "nodes", "calls", "imports", "edges", "import_edges", "adjacency", "postings", "statistics", "meta")
log = logging.getLogger(__name__)


class Engine:
    """Tables of an indexed project and the tools over them. ``store``: the folder of the versions; a new shared one without it."""

    def __init__(self, spark: SparkSession, root: str = "/", store: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self.store = (store or new_path(spark, "index")).rstrip("/")
        self.version: str | None = None
        self.files = self.nodes = self.calls = self.imports = self.edges = self.import_edges = self.adjacency = self.postings = self.statistics = self.meta = None

    # --- versions ------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _pointer(self) -> dict | None:
        files, target = self._fs(f"{self.store}/current")
        return json.loads(read_bytes(self.spark, f"{self.store}/current")) if files.exists(target) else None

    def open(self) -> Engine:
        """Read the current version of the store."""
        now = self._pointer()
        if now is None:
            raise FileNotFoundError(f"{self.store} holds no index")
        self.version = now["version"]
        for name in TABLES:
            setattr(self, name, self.spark.read.parquet(f"{self.store}/{now['tables'][name]}"))
        return self

    def commit(self, tables: dict[str, DataFrame]) -> Engine:
        """Write the tables, then move the pointer to the version that they make with the stored ones that did not change.

        What only the version before the last one used is deleted: who reads the last one still can.
        """
        fresh, last = f"v-{uuid.uuid4().hex}", self._pointer() if self.version else None
        held = dict(last["tables"]) if last else {}
        for name, table in tables.items():
            table.write.parquet(f"{self.store}/{fresh}/{name}")
        now = held | {name: f"{fresh}/{name}" for name in tables}
        jvm = self.spark._jvm
        files, target = self._fs(f"{self.store}/current-{fresh}")
        out = files.create(target, True)
        out.write(bytearray(json.dumps({"version": fresh, "tables": now, "before": held}).encode()))
        out.close()
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        names.rename(target, jvm.org.apache.hadoop.fs.Path(f"{self.store}/current"), replace)
        for folder in set(last["before"].values() if last else ()) - set(held.values()) - set(now.values()):
            delete_path(self.spark, f"{self.store}/{folder}")
        return self.open()

    def get_meta(self, key: str) -> str | None:
        row = self.meta.where(F.col("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str) -> Engine:
        return self.commit({"meta": self._meta({key: value})})

    def _meta(self, values: dict[str, str]) -> DataFrame:
        """The stored (key, value) rows with these in their place."""
        pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v) for v in values.values()]))
        fresh = self.spark.range(1).select(F.explode(pairs).alias("key", "value"))
        return fresh if self.meta is None else self.meta.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)

    # --- indexing ------------------------------------------------------------------------------------------

    def _modules(self, imports: DataFrame, files: DataFrame) -> DataFrame:
        """imports (path, local_name, module) with module_path: the file of a module of the project, else the module as written."""
        sibling, folder = rust_candidates(F.col("path"), F.col("module"))
        rust = language_of(F.col("path")) == "rust"
        rows = imports.withColumn("_a", F.when(rust, sibling)).withColumn("_b", F.when(rust, folder))
        for k in ("_a", "_b"):
            rows = rows.join(files.select(F.col("path").alias(f"{k}p")), F.col(k) == F.col(f"{k}p"), "left")
        found = F.when(rust, F.coalesce("_ap", "_bp", "module")).otherwise(module_file(F.col("path"), F.col("module")))
        return rows.select("path", "local_name", "module", found.alias("module_path"))

    def _derived(self, files: DataFrame, nodes: DataFrame, imports: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
        """The tables that follow from others alone."""
        ids = files.select("path", "file_id")
        by_module = ids.select(F.col("path").alias("module_path"), F.col("file_id").alias("imported_file_id"))
        met = imports.join(by_module, "module_path").join(ids, "path").select(F.col("file_id").alias("importer_file_id"), "imported_file_id")
        return {"import_edges": met.distinct(), "adjacency": graph.adjacency(edges), "statistics": search.term_statistics(nodes)}

    def _meta_now(self, batch: int) -> dict[str, str]:
        return {"root": self.root, "indexed_at": str(self.spark.range(1).select(F.unix_timestamp().alias("t")).first()["t"]), "last_batch": str(batch)}

    def index(self, files: DataFrame) -> Engine:
        """files: (path, language, content). Calls are resolved after all symbols exist, so order does not matter."""
        files = files if "content_hash" in files.columns else files.withColumn("content_hash", F.unhex(F.md5("content")))
        files = cut(files.withColumn("file_id", F.xxhash64("path")))
        nodes, calls, imports = frontends.tables(cut(frontends.extract(files)))
        nodes, imports = cut(nodes), cut(self._modules(imports, files))
        calls = cut(resolve.resolve_calls(calls, imports, nodes))
        edges = cut(relational.dedup_edges(resolve.call_edges(calls, nodes)))
        tables = {"files": files, "nodes": nodes, "calls": calls, "imports": imports, "edges": edges, "postings": search.postings(nodes), "meta": self._meta(self._meta_now(-1))}
        return self.commit(tables | self._derived(files, nodes, imports, edges))

    def index_project(self, project_root: str, **options) -> DataFrame:
        """Index the files under a root, by the options of ``scan_files`` or of the configuration file there; (calls, resolved, unresolved)."""
        self.root = project_root.rstrip("/")
        files, target = self._fs(f"{self.root}/{CONFIG}")
        known = load_config(read_bytes(self.spark, f"{self.root}/{CONFIG}").decode() if files.exists(target) else "")
        settings = {"ignore": known["ignore"], "max_size": known["max_file_size"], "follow_symlinks": known["follow_symlinks"]} | options
        self.index(scan_files(self.spark, self.root, **settings))
        return self.calls.agg(F.count("*").alias("calls"), F.count_if(F.col("strategy") != "Unresolved").alias("resolved"), F.count_if(F.col("strategy") == "Unresolved").alias("unresolved"))

    def apply(self, changes: DataFrame, batch: int | None = None) -> Engine:
        """The next version after changes (path, kind, ts, content); kind is create, modify or remove. A ``foreachBatch`` function.

        Of a path the last change counts. Removals of unknown files and contents that are stored already change nothing, and
        neither does a batch that was applied before. Only changed files are read; calls are resolved again where they are in
        a changed file, in a file whose imports now lead elsewhere, or name a symbol that a changed file has or had.
        """
        if batch is not None and batch <= int(self.get_meta("last_batch") or -1):
            return self
        last = changes.groupBy("path").agg(F.max_by(F.struct("kind", "content"), "ts").alias("l")).select("path", "l.*")
        last = last.withColumn("content_hash", F.unhex(F.md5("content"))).withColumn("language", language_of(F.col("path")))
        last = cut(last.where((F.col("kind") == "remove") | F.col("language").isNotNull()))
        gone = H.keep_known(last.where("kind = 'remove'"), self.files).select("path")
        fresh = H.dedup_against(last.where("kind <> 'remove'"), self.files)
        touched = cut(fresh.select("path").unionByName(gone))
        if touched.isEmpty():
            return self if batch is None else self.set_meta("last_batch", str(batch))
        new = fresh.select("path", "language", "content", "content_hash", F.octet_length("content").cast("long").alias("size"), F.unix_timestamp().alias("mtime"))
        new = cut(new.withColumn("file_id", F.xxhash64("path")).select(*[c for c in self.files.columns if c in (*new.columns, "file_id")]))
        without = lambda table: table.join(touched, "path", "left_anti").select(*table.columns)
        files = cut(without(self.files).unionByName(new))
        # Extraction needs the file alone; the files that import it are only resolved again.
        nodes_new, calls_new, imports_new = frontends.tables(cut(frontends.extract(new)))
        nodes = cut(without(self.nodes).unionByName(nodes_new))
        raw = without(self.imports).select("path", "local_name", "module").unionByName(imports_new)
        imports = cut(self._modules(raw, files))
        names = self.nodes.join(touched, "path", "left_semi").select("name").unionByName(nodes_new.select("name")).distinct()
        key = ["path", "local_name", "module_path"]
        moved = imports.select(*key).exceptAll(self.imports.select(*key)).select("path").unionByName(self.imports.select(*key).exceptAll(imports.select(*key)).select("path")).distinct()
        site = calls_new.columns
        old = without(self.calls).withColumn("_name", resolve.called_name(F.col("callee")))
        again = old.join(names.select(F.col("name").alias("_name"), F.lit(True).alias("_hit")), "_name", "left").join(moved.withColumn("_moved", F.lit(True)), "path", "left")
        again = cut(again.withColumn("_again", F.col("_hit").isNotNull() | F.col("_moved").isNotNull()))
        todo = cut(again.where("_again").select(*site).unionByName(calls_new))
        resolved = resolve.resolve_calls(todo, imports, nodes)
        calls = cut(again.where("not _again").select(*self.calls.columns).unionByName(resolved.select(*self.calls.columns)))
        paths = todo.select("path").unionByName(touched).distinct()
        kept = self.edges.join(paths, "path", "left_anti").select(*self.edges.columns)
        edges = cut(kept.unionByName(relational.dedup_edges(resolve.call_edges(calls.join(paths, "path", "left_semi").select(*self.calls.columns), nodes)).select(*self.edges.columns)))
        lost = self.nodes.join(touched, "path", "left_semi").select("node_id")
        postings = self.postings.join(lost, "node_id", "left_anti").select(*self.postings.columns).unionByName(search.postings(nodes_new).select(*self.postings.columns))
        number = batch if batch is not None else int(self.get_meta("last_batch") or -1)
        tables = {"files": files, "nodes": nodes, "calls": calls, "imports": imports, "edges": edges, "postings": postings, "meta": self._meta(self._meta_now(number))}
        return self.commit(tables | self._derived(files, nodes, imports, edges))

    def dependents(self, paths: list[str]) -> DataFrame:
        """(file_id, path, level): the files, all that import them over any number of steps, and their order: producers first."""
        changed = self.files.where(F.col("path").isin([self.resolve_path(p) for p in paths])).select("file_id")
        reached = cut(graph.closure(self.import_edges, changed))
        inside = self.import_edges.join(reached.withColumnRenamed("file_id", "importer_file_id"), "importer_file_id", "left_semi").join(reached.withColumnRenamed("file_id", "imported_file_id"), "imported_file_id", "left_semi")
        levels = graph.topo_levels(inside.select(F.col("importer_file_id").alias("file_id"), F.col("imported_file_id").alias("needs")), reached)
        return levels.join(self.files.select("file_id", "path"), "file_id").orderBy(F.col("level").asc_nulls_last(), "path")

    def watch(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a stream of changes batch by batch; a batch that fails is logged and left out, and ``stop()`` ends it."""

        def one(batch: DataFrame, number: int) -> None:
            try:
                self.apply(batch, number)
            except Exception:
                log.exception("changes of batch %d are left out", number)

        return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()

    # --- tools -----------------------------------------------------------------------------------------------

    def resolve_path(self, path: str) -> str:
        """The path under the root, without ``.`` and ``..``; on this machine symbolic links are followed."""
        whole = posixpath.normpath(path if path.startswith("/") else f"{self.root}/{path}")
        return os.path.realpath(whole) if os.path.exists(whole) else whole

    def _symbol(self, name: str) -> DataFrame:
        wanted = self.nodes.where(F.col("qualified_name").isin(name, f"{self.root}/{name}"))
        return wanted.orderBy(F.desc(F.col("qualified_name") != name), F.desc("line_start")).limit(1)

    def _id(self, name: str) -> int:
        row = self._symbol(name).select("node_id").first()
        return row["node_id"] if row else 0

    def _named(self, reached: DataFrame) -> DataFrame:
        return reached.join(self.nodes.select("node_id", "name", "qualified_name", "path"), "node_id").orderBy("depth", "qualified_name")

    def _with_sites(self, reached: DataFrame, sites: DataFrame) -> DataFrame:
        """Reached nodes with the file and line of the call, for direct ones; of several calls the last line."""
        last = sites.groupBy("node_id").agg(F.max_by(F.struct("path", "line"), "line").alias("at")).select("node_id", F.col("at.path").alias("file"), F.col("at.line").alias("line"), F.lit(1).alias("depth"))
        return self._named(reached.join(last, ["node_id", "depth"], "left"))

    def get_index_status(self) -> DataFrame:
        """(metric, value, text): counts, and the stored values as text."""
        counts = relational.index_status(self.files, self.nodes, self.edges, self.import_edges)
        return counts.withColumn("text", F.lit(None).cast("string")).unionByName(self.meta.select(F.col("key").alias("metric"), F.lit(None).cast("long").alias("value"), F.col("value").alias("text")))

    def search_symbols(self, query: str, limit: int = 20) -> DataFrame:
        return search.symbol_search(self.nodes, query, limit, index=self.postings, statistics=self.statistics)

    def get_symbol(self, qualified_name: str) -> DataFrame:
        return self._symbol(qualified_name).join(relational.degrees(self.nodes, self.edges).drop("qualified_name"), "node_id")

    def get_file_outline(self, file_path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == self.resolve_path(file_path)).orderBy("line_start")

    def find_references(self, qualified_name: str) -> DataFrame:
        return relational.find_references(self.edges, self.nodes, self._id(qualified_name))

    def find_definition(self, caller_qualified_name: str, call_line: int | str | None = None) -> DataFrame:
        return relational.find_definition(self.edges, self.nodes, self._id(caller_qualified_name), None if call_line is None else int(call_line))

    def search_code(self, pattern: str, file_glob: str | None = None, limit: int = 50) -> DataFrame:
        return search.search_code(self.files, pattern, self.nodes, glob_suffix(file_glob) if file_glob else "", limit)

    def get_callers(self, source: str, max_depth: int = 20) -> DataFrame:
        sites = self.edges.where(F.col("target_id") == self._id(source)).select(F.col("source_id").alias("node_id"), "path", "line")
        return self._with_sites(graph.reach(self.adjacency, self._symbol(source), max_depth or 1, reverse=True, ready=True), sites)

    def get_callees(self, source: str, max_depth: int = 20) -> DataFrame:
        sites = self.edges.where(F.col("source_id") == self._id(source)).select(F.col("target_id").alias("node_id"), "path", "line")
        return self._with_sites(graph.reach(self.adjacency, self._symbol(source), max_depth or 1, ready=True), sites)

    def get_call_path(self, source: str, target: str, max_depth: int = 20) -> DataFrame:
        path = graph.call_path(self.adjacency, self._id(source), self._id(target), max_depth, ready=True)
        return path.join(self.nodes.select("node_id", "qualified_name"), "node_id").orderBy("hop")

    def get_impact_radius(self, source: str, max_depth: int = 10) -> DataFrame:
        return self._named(graph.impact_radius(self.adjacency, self._symbol(source), max_depth or 10, ready=True))

    def detect_dead_code(self) -> DataFrame:
        return graph.dead_code(self.nodes, self.edges).orderBy("path", "line_start")

    def _communities(self) -> tuple[DataFrame, DataFrame]:
        adjacency = cut(communities.symmetrised(self.edges))
        labels = communities.detect_in(self.nodes, adjacency)
        return communities.summary(adjacency, labels), labels

    def get_communities(self) -> DataFrame:
        """Communities of more than one member, largest first, with their ordinal, weights to one decimal place and members' names."""
        found, labels = self._communities()
        top = cut(communities.ranked(communities.largest(found)))
        inside = labels.join(F.broadcast(top.select("community")), "community")  # as many rows as are listed
        names = inside.join(self.nodes.select("node_id", "qualified_name"), "node_id").groupBy("community").agg(F.sort_array(F.collect_list("qualified_name")).alias("members"))
        return top.join(names, "community").orderBy("ordinal")

    def get_architecture(self) -> DataFrame:
        folders = relational.module_structure(self.nodes, self.root).select(F.lit("folder").alias("part"), F.col("folder").alias("item"), F.col("files").alias("value"))
        entries = relational.entry_points(self.nodes).select(F.lit("entry"), "qualified_name", F.lit(1).cast("long"))
        hubs = relational.hubs(self.edges).join(self.nodes.select("node_id", "qualified_name"), "node_id").select(F.lit("hub"), "qualified_name", "callers")
        languages = self.files.groupBy("language").agg(F.count("*").alias("n")).select(F.lit("language"), "language", "n")
        counts = self.get_index_status().where("value is not null").select(F.lit("count"), "metric", "value")
        total = relational.all_entry_points(self.nodes).agg(F.count("*").alias("n")).select(F.lit("entry_total"), F.lit("all"), "n")
        found = cut(self._communities()[0])
        groups = communities.largest(found).select(F.lit("community"), F.col("community").cast("string"), "n_members")
        sizes = communities.sizes(found).select(F.lit("count"), "item", "value")
        return folders.union(entries).union(hubs).union(languages).union(counts).union(total).union(groups).union(sizes)

    def changed_paths(self, git_ref: str | None = None) -> list[str]:
        """The paths that ``git diff`` names for the working tree of the root, or against ``git_ref``."""
        if (git_ref or "").startswith("-"):
            raise ValueError(f"{git_ref} is no revision")
        command = ["git", "-C", self.root, "diff", "--name-only", "--no-color", *([git_ref] if git_ref else []), "--"]
        done = subprocess.run(command, capture_output=True, text=True, check=False)
        if done.returncode:
            raise ValueError(f"git diff failed for {self.root}: {done.stderr.strip()}")
        return [x for x in done.stdout.splitlines() if x]

    def get_git_impact(self, paths: list[str] | None = None, git_ref: str | None = None) -> DataFrame:
        """Symbols of the files that ``paths`` or else a diff names, with the symbols that call them within 5 steps and the risk."""
        names = self.changed_paths(git_ref) if paths is None else paths
        changed = self.files.select("path").where(F.col("path").isin([self.resolve_path(p) for p in names]))
        return graph.change_impact(self.nodes, self.adjacency, changed, ready=True)

    TOOLS = (
        "index_project", "get_index_status", "search_symbols", "get_symbol", "get_file_outline", "find_references", "find_definition", "search_code", "get_callers",
        "get_callees", "get_call_path", "get_impact_radius", "detect_dead_code", "get_communities", "get_architecture", "get_git_impact",
    )

    def query(self, tool: str, args: dict | None = None) -> DataFrame:
        if tool not in self.TOOLS:
            raise ValueError(f"unknown tool {tool}; known are {', '.join(self.TOOLS)}")
        return getattr(self, tool)(**(args or {}))
