"""Publication: what a run writes about a topic appears together or not at all.

Rows (topic, file, content) are text files of topics. Tasks write into the run's own
folder; the last step of the write replaces one small manifest that names the run of
each topic, so readers see a topic's old files until then and all its new ones from
then on. A run that fails leaves the manifest as it is, and its folder is removed.
Topics that a run does not write keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from brindle.sources.readers import every_plan_filtered, filters_reach_sources

MANIFEST = "manifest.json"
SCHEMA = "topic string, file string, content string"


def open_folder(path: str):
    """(file system, path in it) of a URI or a local path, in any Python process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read_manifest(path: str) -> dict[str, str]:
    """The run of each published topic."""
    files, root = open_folder(path)
    if not files.get_file_info(f"{root}/{MANIFEST}").is_file:
        return {}
    with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def _name(text: str | None) -> str:
    if not text or "/" in text or "\\" in text or text in (".", ".."):
        raise ValueError(f"no name of a topic or file: {text!r}")
    return text


@dataclass
class Written(WriterCommitMessage):
    topics: set[str]


class PublicationWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = open_folder(self.path)
        topics: set[str] = set()
        for row in iterator:
            folder = f"{root}/{self.run}/{_name(row.topic)}"
            if row.topic not in topics:
                files.create_dir(folder, recursive=True)
                topics.add(row.topic)
            # Another attempt of this task writes the same names again.
            with files.open_output_stream(f"{folder}/{_name(row.file)}") as stream:
                stream.write((row.content or "").encode())
        return Written(topics)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = open_folder(self.path)
        old = read_manifest(self.path)
        new = {topic: self.run for m in messages if m for topic in m.topics}
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}.{self.run}") as stream:
            stream.write(json.dumps(old | new, sort_keys=True).encode())
        files.move(f"{root}/{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")
        for topic in old.keys() & new.keys():
            files.delete_dir(f"{root}/{old[topic]}/{topic}")
        used = set((old | new).values())
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.Directory and info.base_name not in used:
                files.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = open_folder(self.path)
        if files.get_file_info(f"{root}/{self.run}").type.name == "Directory":
            files.delete_dir(f"{root}/{self.run}")


class _Topic(InputPartition):
    def __init__(self, topic: str, run: str) -> None:
        super().__init__((topic, run))


class PublicationReader(DataSourceReader):
    """One task a topic."""

    def __init__(self, options: dict) -> None:
        self.path, self.topics = options["path"], None

    def partitions(self) -> list[InputPartition]:
        found = read_manifest(self.path)
        return [_Topic(t, run) for t, run in sorted(found.items()) if self.topics is None or t in self.topics]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:
            return
        topic, run = partition.value
        files, root = open_folder(self.path)
        for info in files.get_file_info(fs.FileSelector(f"{root}/{run}/{topic}")):
            with files.open_input_stream(info.path) as stream:
                yield topic, info.base_name, stream.read().decode()


class FilteredPublicationReader(PublicationReader):
    """A filter on ``topic`` reads only its files."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("topic",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.topics = wanted if self.topics is None else self.topics & wanted
            else:
                yield f


class Publication(DataSource):
    """Option ``path``: a folder that driver and executors share (a local path or a
    URI that Arrow can open). One run publishes into it at a time."""

    @classmethod
    def name(cls) -> str:
        return "brindle_publication"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PublicationWriter(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return (FilteredPublicationReader if self.options.get("filters") == "true" else PublicationReader)(dict(self.options))


def publish(df: DataFrame, path: str) -> None:
    """Publish (topic, file, content) rows: all files of the topics in ``df``, or none.

    A file name that a topic has twice keeps either content. Names that are
    empty or hold a slash are an error, and nothing is published then.
    """
    df.sparkSession.dataSource.register(Publication)
    df.select("topic", "file", "content").write.format("brindle_publication").mode("append").save(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(topic, file, content) of what is published; no rows before the first run."""
    spark.dataSource.register(Publication)
    return every_plan_filtered(spark.read.format("brindle_publication").option("filters", filters_reach_sources(spark)).load(path), "file")
