"""Tables of one engine as Parquet folders under a root: append, replace, delete, back up, count.

A write goes to a new version folder, which counts once it is complete, so that readers and failed
jobs never see half a table.  The version before stays for those that read it; older ones go.
Appends add files to the current version.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and the
    master is local, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="loamgraph-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Columns that tell the rows of a table apart, where it isn't the id.
KEYS = {"triples": ["s", "p", "o"]}

SCHEMAS = {
    "collections": "id string, name string, created_at timestamp",
    "embeddings": "id string, collection string, doc_id string, vector array<float>, content string, metadata map<string,string>, acl array<string>, created_at timestamp",
    "documents": "id string, source string, content string, metadata map<string,string>, created_at timestamp",
    "sessions": "id string, name string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "messages": "id string, session_id string, role string, content string, metadata map<string,string>, created_at timestamp",
    "knowledge": "id string, collection string, title string, content string, source_url string, author string, metadata map<string,string>, entities array<string>, version int, created_at timestamp, updated_at timestamp",
    "chunks": "id string, knowledge_id string, collection string, chunk_no int, content string",
    "memories": "id string, user_id string, session_id string, scope string, namespace string, role string, content string, vector array<float>, metadata string, importance double, ttl_seconds int, expires_at timestamp, created_at timestamp, updated_at timestamp",
    "graph_nodes": "id string, type string, labels array<string>, properties map<string,string>, created_at timestamp",
    "graph_edges": "id string, from_id string, to_id string, type string, weight double, properties map<string,string>, created_at timestamp",
    "triples": "s string, p string, o string, kind_o string, datatype string, language string, graph string, inferred boolean",
}


class Engine:
    """All tables under `root`, a folder that every executor sees."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self, table: str) -> str | None:
        fs, p = self._files(f"{self.root}/{table}")
        if not fs.exists(p):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))
        done = [v for v in done if fs.exists(self._files(f"{self.root}/{table}/{v}/_SUCCESS")[1])]
        return done[-1] if done else None

    def read(self, table: str) -> DataFrame:
        v = self._version(table)
        if v is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{v}")

    def _fit(self, table: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        return rows.select(*[(rows[f.name] if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows without an id get a new one."""
        fit = self._fit(table, rows)
        if "id" in fit.columns:
            fit = fit.withColumn("id", F.coalesce("id", F.expr("uuid()")))
        v = self._version(table) or "v0000000000"
        fit.write.mode("append").parquet(f"{self.root}/{table}/{v}")

    def replace(self, table: str, rows: DataFrame) -> None:
        old = self._version(table)
        number = int(old[1:11]) + 1 if old else 0
        self._fit(table, rows).write.parquet(f"{self.root}/{table}/v{number:010d}-{uuid.uuid4().hex[:8]}")
        fs, p = self._files(f"{self.root}/{table}")
        for v in sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("v")):
            if old and v < old:
                fs.delete(self._files(f"{self.root}/{table}/{v}")[1], True)

    def upsert(self, table: str, rows: DataFrame, key: str | Sequence[str] | None = None) -> None:
        """Rows in place of those of the same key; of several new ones of a key one is taken."""
        keys = [key] if isinstance(key, str) else list(key or KEYS.get(table, ["id"]))
        new = self._fit(table, rows).dropDuplicates(keys)
        self.replace(table, self.read(table).join(new.select(*keys), keys, "left_anti").unionByName(new))

    def delete(self, table: str, where: Column) -> None:
        self.replace(table, self.read(table).where(~F.coalesce(where, F.lit(False))))

    def get(self, table: str, id_: str) -> DataFrame:
        return self.read(table).where(F.col("id") == id_)

    def scan(self, table: str, collection: str, vectors: bool = True) -> DataFrame:
        rows = self.read(table).where(F.col("collection") == collection)
        return rows if vectors or "vector" not in rows.columns else rows.drop("vector")

    def insert_text(self, texts: DataFrame, embed) -> None:
        """Rows (collection, doc_id, content) with their vectors by `embed`, a Column to Column function; blank texts are skipped."""
        self.append("embeddings", texts.where(F.trim("content") != "").withColumn("vector", embed(F.col("content"))))

    def create_collection(self, name: str) -> None:
        """A name is taken by creating its file, which the file system does for one caller alone."""
        fs, p = self._files(f"{self.root}/_names/{hashlib.sha256(name.encode()).hexdigest()}")
        if not fs.createNewFile(p):
            raise ValueError(f"there is a collection {name}")
        self.append("collections", self.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("created_at")))

    def collections(self) -> DataFrame:
        return self.read("collections").orderBy("name")

    def collection(self, name: str) -> DataFrame:
        """The collection's row; an unknown name is an error."""
        row = self.read("collections").where(F.col("name") == name)
        if row.isEmpty():
            raise KeyError(f"there is no collection {name}")
        return row

    def delete_collection(self, name: str) -> None:
        self.delete("collections", F.col("name") == name)
        fs, p = self._files(f"{self.root}/_names/{hashlib.sha256(name.encode()).hexdigest()}")
        fs.delete(p, False)
        self.delete("embeddings", F.col("collection") == name)

    def delete_session(self, session_id: str) -> None:
        self.delete("sessions", F.col("id") == session_id)
        self.delete("messages", F.col("session_id") == session_id)

    def stats(self) -> DataFrame:
        out = None
        for t in ("collections", "embeddings", "sessions", "messages", "documents"):
            n = self.read(t).agg(F.count("*").alias(t))
            out = n if out is None else out.crossJoin(n)
        return out

    def backup(self, path: str) -> None:
        for t in SCHEMAS:
            if self._version(t) is not None:
                self.read(t).write.parquet(f"{path}/{t}")

    def restore(self, path: str) -> None:
        for t in SCHEMAS:
            fs, p = self._files(f"{path}/{t}")
            if fs.exists(p):
                self.replace(t, self.spark.read.schema(SCHEMAS[t]).parquet(f"{path}/{t}"))


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of text and Markdown files below a folder."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    return d.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
