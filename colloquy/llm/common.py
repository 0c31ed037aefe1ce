"""What the operators of this folder share: tables in the shared folder, words, hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import shared_root, ship

#: The characters between words: space, and tab to carriage return.
GAPS = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    ``drop`` removes those that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._scratch)
            at.getFileSystem(conf).delete(at, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAPS))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def settled(df: DataFrame, name: str, c: Column) -> DataFrame:
    """With column ``name`` computed once.

    The optimizer moves filters below projections by repeating their expressions, also
    inside lambda functions, where they would run again for every element. It does not
    move them below a generator, so the value is made the only row of one.
    """
    return df.withColumn(name, F.explode_outer(F.array(c)))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns."""
    lower = {c.lower() for c in columns}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def row_key(columns: list[str]) -> Column:
    """128 bits of hashes of a row: rows that share it agree in all these columns, nulls apart from values."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts)))


def with_before(t: DataFrame, group: list[str], levels: dict[str, Column], order: list[str], weight: str, name: str, scratch: Scratch) -> DataFrame:
    """With column ``name``, the sum of ``weight`` over the rows before each in the order within its group.

    ``levels`` coarsen the order step by step. What lies before a row is a sum over earlier
    cells of the first level, earlier cells of the second within its own, and so on, and
    over the rows of the last cell, so that no task orders a whole group. Group columns
    and levels must not be null.
    """
    keys, before = list(group), F.lit(0).cast("long")
    made = []
    for k, (level, c) in enumerate(levels.items()):
        t = t.withColumn(level, c)
        cells = t.groupBy(*keys, level).agg(F.sum(weight).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        cells = scratch.keep(cells.select(*keys, level, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(f"_before{k}")))
        keys.append(level)
        made.append(f"_before{k}")
        t = t.join(cells, keys)
        before = before + F.col(f"_before{k}")
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn(name, (before + F.coalesce(F.sum(weight).over(own), F.lit(0))).cast("long")).drop(*made, *levels)
