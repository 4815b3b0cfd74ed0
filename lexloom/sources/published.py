"""Tables that change in one step: files first, then a record that names them.

A table's folder holds data/__version=<token>/, the files of each write, and commits/<number>.json, small records. The record
of the highest number says which folders are the table, and which batch of each stream it holds. A write that fails before its
record leaves readers with the old rows; a record is put in place by one rename, which fails if another writer was first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = "__version"


class Conflict(RuntimeError):
    """Another writer has published since the table was read."""


class _Folder:
    """The file system that a table lies in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def put(self, name: str, text: str) -> None:
        """A small file, whole or not at all; an error if there is one of that name."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.at(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf).rename(self.at(beside), self.at(name), none)
        except Exception as e:
            self.fs.delete(self.at(beside), False)
            if self.fs.exists(self.at(name)):
                raise Conflict(f"{self.path}: {name} is taken") from e
            raise

    def text(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(str(self.at(name)), wholetext=True).collect())


def _records(folder: _Folder) -> list[str]:
    return [n for n in folder.names("commits") if n.endswith(".json")]


def current(spark: SparkSession, path: str) -> dict | None:
    """The record that readers go by: number, folders, batches, report; none if nothing is published."""
    folder = _Folder(spark, path)
    names = _records(folder)
    return json.loads(folder.text(f"commits/{names[-1]}")) | {"number": int(names[-1].split(".")[0])} if names else None


def publish(df: DataFrame, path: str, partition_by: str | None = None, base: dict | None = None, batch: tuple[str, int] | None = None, report: DataFrame | None = None) -> dict:
    """Write a table and put its record in place.

    base: a record to go on from, whose other partitions stay; none: all is replaced. batch: a stream's name and the number of the batch
    that this makes part of the table. A report is written beside, and is part of the same record."""
    spark, token = df.sparkSession, uuid.uuid4().hex
    folder = _Folder(spark, path)
    seen = current(spark, path)
    if base is not None and seen is not None and seen["number"] != base["number"]:
        raise Conflict(f"{path}: record {seen['number']} came after {base['number']}")
    data = f"data/{VERSION}={token}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(str(folder.at(data)))
    if report is not None:
        report.write.json(str(folder.at(f"report/{token}")))
    made = {n: f"{data}/{n}" for n in folder.names(data) if n.startswith(f"{partition_by}=")} if partition_by else {"": data}
    record = {
        "folders": {**(base or {}).get("folders", {}), **made}, "partition_by": partition_by, "schema": df.schema.json(),
        "batches": {**(base or seen or {}).get("batches", {}), **({batch[0]: batch[1]} if batch else {})}, "report": f"report/{token}" if report is not None else None,
    }
    number = (seen["number"] if seen else 0) + 1
    folder.put(f"commits/{number:020}.json", json.dumps(record))
    return record | {"number": number}


def read_published(spark: SparkSession, path: str, record: dict | None = None, partitions: list[str] | None = None) -> DataFrame:
    """The table as the latest, or a given, record says; of `partitions` alone, folder names such as corpus_id=a, if given."""
    record = record or current(spark, path)
    if record is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    schema = T.StructType.fromJson(json.loads(record["schema"]))
    folders = [f for n, f in record["folders"].items() if partitions is None or n in partitions]
    if not folders:
        return spark.createDataFrame([], schema)
    root = path.rstrip("/")
    reader = spark.read.schema(schema).option("basePath", f"{root}/data")
    return reader.parquet(*[f"{root}/{f}" for f in folders]).select(*[f"`{c}`" for c in schema.names])


def clean_up(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the files and records that none of the last `keep` records needs; how many folders went. Readers of older records, and
    writers that have not put their record yet, must have ended."""
    folder = _Folder(spark, path)
    names = _records(folder)
    needed = {f.split("/")[1] for n in names[-keep:] for f in json.loads(folder.text(f"commits/{n}"))["folders"].values()}
    gone = [n for n in folder.names("data") if n not in needed]
    for n in gone:
        folder.fs.delete(folder.at(f"data/{n}"), True)
    for n in names[:-keep]:
        folder.fs.delete(folder.at(f"commits/{n}"), False)
    return len(gone)
