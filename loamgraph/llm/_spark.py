"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, visible to all executors.

    Where it is unset, as in tests, a temporary folder is set for a local master; on any other
    master that would lose data, so it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loamgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.  Spark removes the files once
    nothing refers to them where spark.cleaner.referenceTracking.cleanCheckpoints is true."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in a folder of their own in the shared folder, removed at the end of the `with`, also after
    a failure.  Only for tables that no returned plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, written once and read from there."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Rows of one key beyond which a join deals them to several tasks, and keys so dealt at most: any
#: further one has less than a MOST_HOT-th of the rows, which adaptive execution splits.
HOT = 1 << 20
MOST_HOT = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined with groups, a table of one row for each key that also says how many rows have it.

    Rows of a key of at least `hot` rows are dealt by a hash of `spread` to tasks of about so many,
    each of which gets a copy of the key's group.
    """
    many = groups.where(F.col(size) >= hot).orderBy(F.desc(size), *keys).limit(MOST_HOT).select(*keys, F.ceil(F.col(size) / hot).cast("int").alias("_parts"))
    found = many.collect()
    if not found:
        return rows.join(groups.drop(size), keys, how)
    table = F.broadcast(rows.sparkSession.createDataFrame(found, many.schema))
    parts = F.coalesce("_parts", F.lit(1))
    r = rows.join(table, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    g = groups.drop(size).join(table, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return r.join(g, [*keys, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with each of the columns under its own name and every other under one of its position,
    so names that differ in case alone, or not at all, are never ambiguous.  A column is the first of
    exactly its name, else the first of that name in any case."""
    place = {}
    for c in dict.fromkeys(columns):
        found = [i for i, x in enumerate(df.columns) if x == c] or [i for i, x in enumerate(df.columns) if x.lower() == c.lower()]
        if not found:
            raise ValueError(f"there is no column {c} among {df.columns}")
        place[found[0]] = c
    return df.toDF(*[place.get(i, f"c{i}__") for i in range(len(df.columns))])


def text_input(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text (as a string, null where null) and nothing else, so extra
    columns of the input never reach Python nor clash with an operator's own names."""
    docs = named(docs, *columns, text)
    return docs.select(*columns, docs[text].cast("string").alias("text"))


def with_text(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """The columns and the text as a string, and under which name it is there: its own where that column is
    among them and a string, so that no text goes to Python twice."""
    if "text" in columns and dict(docs.dtypes)["text"] == "string":
        return docs.select(*columns), "text"
    return docs.select(*columns, F.col("text").cast("string").alias("_text")), "_text"


def text_key(text_column: str = "text") -> F.Column:
    """A 64-bit identity of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


#: Columns that operators know by name; a stage sees any other under a name of its position.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def any_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that keeps all columns of its input, whatever names the extra ones have."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        have = {c.lower() for c in docs.columns}
        known = [n for n in KNOWN if n in have]
        return stage(named(docs, *known), *args, **kwargs).toDF(*docs.columns)

    return run
