"""Named documents: one file for each key under its own name, in any store that pyarrow reaches, written whole or not at all.

Tasks write under random names in a hidden folder below the root; what the committed attempts wrote is moved to its name by the
commit, and the hidden folder goes. A task that is killed, tried again or run twice leaves nothing under a document's name.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planning worker may not have this package on its path
DOCUMENT = "path string, value string"


def store_of(root: str):
    """The store of a path, and the path there."""
    from pyarrow import fs

    if root.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.hidden = root, overwrite, f".turnloom-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, base = store_of(self.root)
        store.create_dir(f"{base}/{self.hidden}")
        files = []
        for path, value in iterator:
            own = f"{base}/{self.hidden}/{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write((value or "").encode())
            files.append((own, path))
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileType

        store, base = store_of(self.root)
        for own, path in (f for m in messages if m is not None for f in m.files):
            name = f"{base}/{path}"
            there = store.get_file_info(name).type == FileType.File
            if there and not self.overwrite:
                continue
            store.create_dir(name.rpartition("/")[0])
            if there:
                store.delete_file(name)
            store.move(own, name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        store, base = store_of(self.root)
        if store.get_file_info(f"{base}/{self.hidden}").type == FileType.Directory:
            store.delete_dir(f"{base}/{self.hidden}")


class NamedDocuments(DataSource):
    """Options: root, overwrite (true or false). Rows: path below root, value."""

    @classmethod
    def name(cls) -> str:
        return "named_documents"

    def schema(self) -> str:
        return DOCUMENT

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ARG002
        return _Writer(self.options["root"].rstrip("/"), self.options.get("overwrite", "false") == "true")


def plain(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def source_file() -> Column:
    """The plain path of the file that a row was read from."""
    return plain(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))


def listed(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path (below root), full of the files below a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return spark.createDataFrame([], "path string, full string")
    top = store.makeQualified(place).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(root).select(plain(F.col("path")).alias("full"))
    length = len(top) - len("file:") if top.startswith("file:") else len(top)
    return found.select(F.regexp_replace(F.substring("full", length + 1, 1 << 30), "^/+", "").alias("path"), "full")


def write(docs: DataFrame, root: str, overwrite: bool = False) -> None:
    """docs (path below root, value) as files. Those already there are left alone one by one, before their value is made if
    it comes from a join or a model, or replaced if overwrite; files of other names stay. A null value is an empty file."""
    spark = docs.sparkSession
    spark.dataSource.register(NamedDocuments)
    if not overwrite:
        docs = docs.join(listed(spark, root).select("path"), "path", "left_anti")
    docs.select("path", "value").write.format("named_documents").option("root", root).option("overwrite", str(overwrite).lower()).mode("append").save()
