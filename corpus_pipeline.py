"""From raw documents to mixed shards: five stages, each written as Parquet and read again by the next.

Every stage takes documents as they are read from files, whatever further columns they have, and keeps all columns. Nulls in
any column, empty and very long texts, ties and repeated rows are dealt with as each stage says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm import oracles
from codeloom.llm.decontaminate import clean
from codeloom.llm.jaccard_join import JaccardJoin
from codeloom.llm.pfair import interleave
from codeloom.llm.quality_rules import keep_good
from codeloom.llm.queries import SHARDS
from codeloom.llm.resharding import MOST_BLOCKS, reshard
from codeloom.llm.shared import stash, table

#: The mix lies in so many stretches of equal rows before it is cut into shards.
STRETCHES = 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with their whole texts; null and empty texts fail for want of words, equal rows fare alike."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (five words, 0.8) one document: that of least id, one without an id only where no other has one.

    Rows are told apart by their place in the files, so of rows of one id, and of equal rows, one stays too. Texts without words
    are linked with nothing and all stay.
    """
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    found = JaccardJoin(keyed, id_col="__row", ngram=5, percent=80).components()
    met = found.join(keyed.select("__row", "doc_id"), F.col("id") == F.col("__row")).select("__row", "doc_id", "component", "n")
    first = met.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("first"))
    stay = first.select("first.__row").unionByName(met.where("n = 0").select("__row"))
    return keyed.join(stay, "__row", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages worth a twentieth of their words; null texts have none, equal rows fare alike."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the files, in the order of their numbers, hold consecutive stretches of it, sorted.

    Rows without a source are of one source; repeated rows may swap places.
    """
    mixed = interleave(docs.withColumnsRenamed({c: f"__{c}" for c in MIX if c in docs.columns}))
    parts, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), max(docs.count(), 1)
    dealt = mixed.repartitionById(parts, F.expr(f"cast(mix_position * {parts} div {rows} as int)")).sortWithinPartitions("mix_position")
    return dealt.drop(*MIX).withColumnsRenamed({f"__{c}": c for c in MIX if c in docs.columns})


MIX = ("mix_block", "mix_slot", "mix_position")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and slot they go to, and their size and CRC.

    Rows lie in the order of their files' numbers and of their places in them, which is that of the mix; stretches
    of it are the old shards, so new shards are made of stretches of the mix. Rows of any text, null ones too, have a place.
    """
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot")]
    rows = docs.select(*[f"`{c}`" for c in own], F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    number = F.coalesce(F.expr("try_cast(regexp_extract(__file, 'part-([0-9]+)', 1) as long)"), F.lit(0))
    ahead = Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = rows.groupBy("__file").agg(F.count("*").alias("n")).select("__file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    total = max(docs.count(), 1)
    place = (F.col("__start") + F.col("__row")).alias("__place")
    # A row for each file; beyond the bound of a broadcast the texts are dealt by file first.
    placed = rows.join(F.broadcast(starts) if starts.count() <= MOST_BLOCKS else starts, "__file").select(*[f"`{c}`" for c in own], place)
    # Places are gapless from 0; spread over the positive longs they cut into ranges as hashes do.
    out = reshard(placed, F.expr(f"cast(__place * {STRETCHES} div {total} as int)"), SHARDS, order=F.col("__place") * F.lit(((1 << 63) - 1) // total))
    return out.select(*[f"`{c}`" for c in own], "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

ORACLE_SQL = oracles.pipeline(SHARDS, STRETCHES)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
