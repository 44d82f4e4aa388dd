"""Labelled texts for training: a bounded sample, and the split that keeps rows out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import stash

#: UTF-8 bytes of the texts that a model is fitted on at most.
MOST_BYTES = 64 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """One row in four, by the CRC of the id as text; such labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``most`` labelled texts that are not held out, the first by a hash of their ids, and at most ``most_bytes`` of them.

    The bounds are on what is learned from, so what reaches the driver does not grow with the corpus. Texts are whole: one
    that would exceed the bytes is left out, and later ones may still fit. Labels that are null or neither 0 nor 1 are
    left out; of labels that repeat for an id the largest counts, of texts the least, and a null one is empty.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(most)
    met = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col(id_col))
    rows = stash(met.groupBy("_id").agg(F.min("_text").alias("t"), F.max("label").alias("y")), "labelled", small=True)
    left, fit = most_bytes, []
    for r in rows.select("_id", F.octet_length("t").alias("size")).orderBy(F.xxhash64("_id"), "_id").collect():
        if r["size"] <= left:
            fit.append(r["_id"])
            left -= r["size"]
    texts = rows.where(F.col("_id").isin(fit)).orderBy("_id").collect()
    return [r["t"] for r in texts], [int(r["y"]) for r in texts]
