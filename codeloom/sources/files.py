"""Source files as a DataFrame: discovery, ignore rules, size limit and content hashes."""

from __future__ import annotations

import os
import re
import tomllib
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import LANGUAGES, glob_parts, glob_regex, language_of

MAX_SIZE = 1 << 20
CONFIG = "codeloom.toml"
#: Files of rules in a folder, the later ones over the earlier.
IGNORE_FILES = (".gitignore", ".ignore")


def load_config(text: str) -> dict:
    """max_file_size, ignore and follow_symlinks of a TOML text, with defaults for those it lacks."""
    return {"max_file_size": MAX_SIZE, "ignore": [], "follow_symlinks": False} | tomllib.loads(text)


def keep_files(files: DataFrame, *, root: str, ignore: list[str] = (), max_size: int | None = None) -> DataFrame:
    """Files (path, size, ...) that no ignore glob fits and that are not over the size; later ``!`` globs take files back."""
    rest = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "")
    dropped = F.lit(False)
    for glob in ignore:
        hit = rest.rlike(glob_regex(glob.removeprefix("!")))
        dropped = dropped & ~hit if glob.startswith("!") else dropped | hit
    kept = files.where(~dropped)
    return kept.where(F.col("size") <= max_size) if max_size is not None else kept


class Rules:
    """Ignore rules of the folders from the root to a file: deeper ones over those above, within a file the last that fits."""

    def __init__(self):
        self.of: dict[str, list[tuple[bool, bool, re.Pattern, bool]]] = {}

    def add(self, folder: str, text: str) -> None:
        for line in text.splitlines():
            glob = line.rstrip()
            if not glob or glob.startswith("#"):
                continue
            anchored, body, folders = glob_parts(glob.removeprefix("!"))
            try:
                self.of.setdefault(folder, []).append((not glob.startswith("!"), anchored, re.compile(body), folders))
            except re.error as e:
                warnings.warn(f"invalid ignore glob {glob!r}: {e}", stacklevel=2)

    def drops(self, path: str, is_folder: bool = False) -> bool:
        """Whether the rules drop the path, relative to the root. What is in a dropped folder is asked for its folder, not here."""
        verdict, parts = False, path.split("/")
        for k in range(len(parts)):
            for dropped, anchored, pattern, folders in self.of.get("/".join(parts[:k]), ()):
                if (is_folder or not folders) and pattern.fullmatch("/".join(parts[k:]) if anchored else parts[-1]):
                    verdict = dropped
        return verdict


def _walk(spark: SparkSession, root: str, follow: bool):
    """(folder, names of folders, {file: size}, reader of a text) from the root down; folders taken from the list are not entered."""
    if root.startswith("/") and os.path.isdir(root):
        for folder, folders, files in os.walk(root, followlinks=follow):
            folders.sort()
            if not follow:
                folders[:] = [x for x in folders if not os.path.islink(f"{folder}/{x}")]
                files = [x for x in files if not os.path.islink(f"{folder}/{x}")]
            yield folder, folders, {x: os.path.getsize(f"{folder}/{x}") for x in files if os.path.isfile(f"{folder}/{x}")}
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store, todo = path.getFileSystem(spark._jsc.hadoopConfiguration()), [root.rstrip("/")]
    while todo:
        folder = todo.pop()
        found = sorted(((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in store.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))))
        folders = [n for n, is_folder, _ in found if is_folder]
        yield folder, folders, {n: size for n, is_folder, size in found if not is_folder}
        todo += [f"{folder}/{x}" for x in folders]


def read_bytes(spark: SparkSession, path: str) -> bytes:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def discover(spark: SparkSession, root: str, *, ignore: list[str] = (), max_size: int = MAX_SIZE, follow_symlinks: bool = False) -> list[tuple[str, int]]:
    """(path, size) of source files under the root, sorted: known languages, not hidden, not ignored, not over the size.

    The names are listed on the driver, as any file source does. ``.gitignore`` and ``.ignore`` hold for their folder
    and those below; ``ignore`` are globs relative to the root that hold over them.
    """
    root, rules, extra, out = root.rstrip("/"), Rules(), Rules(), []
    extra.add("", "\n".join(ignore))
    for folder, folders, files in _walk(spark, root, follow_symlinks):
        here = folder[len(root) + 1 :]
        for name in IGNORE_FILES:
            if name in files:
                rules.add(here, read_bytes(spark, f"{folder}/{name}").decode("utf-8", "replace"))
        inside = lambda name: f"{here}/{name}" if here else name
        folders[:] = [x for x in folders if not x.startswith(".") and not rules.drops(inside(x), True)]
        for name, size in files.items():
            path = inside(name)
            if name.startswith(".") or name.rpartition(".")[2] not in LANGUAGES or "." not in name or rules.drops(path):
                continue
            if any(extra.drops("/".join(path.split("/")[: k + 1]), k < path.count("/")) for k in range(path.count("/") + 1)):
                continue
            if size <= max_size:
                out.append((f"{root}/{path}", size))
            else:
                warnings.warn(f"{path} is over {max_size} bytes", stacklevel=2)
    return sorted(out)


FILE_COLUMNS = "path string, size bigint, mtime bigint, content binary"


def scan_files(spark: SparkSession, root: str, *, ignore: list[str] = (), max_size: int = MAX_SIZE, follow_symlinks: bool = False) -> DataFrame:
    """(path, language, size, mtime, content, content_hash) of the source files under ``root`` that ``discover`` finds.

    Files that are no UTF-8 are left out, with their rows. Spark's readers pass over names that begin with an
    underscore, so the driver reads those, each at most ``max_size`` bytes.
    """
    found = discover(spark, root, ignore=ignore, max_size=max_size, follow_symlinks=follow_symlinks)
    low = len(root.rstrip("/"))
    plain = [p for p, _ in found if "/_" not in p[low:]]
    other = [(p, n, 0, bytearray(read_bytes(spark, p))) for p, n in found if "/_" in p[low:]]
    rows = spark.createDataFrame(other, FILE_COLUMNS)
    if plain:
        raw = spark.read.format("binaryFile").load(plain)
        path = F.regexp_replace("path", "^file:/*", "/")
        rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content").unionByName(rows)
    text = rows.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where("text is not null")
    return text.select("path", language_of(F.col("path")).alias("language"), "size", "mtime", F.col("text").alias("content"), F.unhex(F.md5("content")).alias("content_hash"))
