"""Source texts to symbols, calls and imports; one task handles many files, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.sources.frontends import lexed, python


def extract_one(path: str, language: str, text: str) -> dict:
    """symbols, calls and imports of one file."""
    if language == "python":
        try:
            return python.extract(path, text)
        except (SyntaxError, ValueError, RecursionError):
            pass  # broken files get what the lexer finds
    return lexed.extract(path, language, text)


def extract(files: DataFrame) -> DataFrame:
    """files (path, language, content) -> (path, symbols, calls, imports)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **extract_one(p, g, c or "")} for p, g, c in zip(batch["path"], batch["language"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "symbols", "calls", "imports"])

    return files.select("path", "language", "content").mapInPandas(run, schema.EXTRACTED)


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, calls, imports with the module as written); node ids are hashes of the qualified name and line, so they are stable over runs."""
    nodes = extracted.select("path", F.explode("symbols").alias("s")).select(F.xxhash64("s.qualified_name", "s.line_start").alias("node_id"), "path", "s.*")
    calls = extracted.select("path", F.explode("calls").alias("c")).select("path", "c.*")
    imports = extracted.select("path", F.explode("imports").alias("i")).select("path", "i.local_name", F.col("i.module_path").alias("module"))
    return nodes, calls, imports
