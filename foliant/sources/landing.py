"""Landing files as a data source, a partition a file: ``spark.dataSource.register(LandingSource)``, then ``spark.read.format("landing").load(folder)``.

With the option ``pushdown`` (and spark.sql.python.filterPushdown.enabled, without which Spark refuses a source that takes filters) what a query asks of a file's name, extension or size
is decided before it is opened, so that no partition is made for a file that is left out. A file is read in pieces, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from foliant.sources.tables import MAX_BYTES

SCHEMA = "name string, extension string, length long, fingerprint string, refused string"
KNOWN = ("name", "extension", "length")
TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


@dataclass
class LandingFile(InputPartition):
    path: str
    name: str
    extension: str
    length: int


class LandingReader(DataSourceReader):
    def __init__(self, folder: str, allowed: tuple[str, ...], most: int):
        self.folder, self.allowed, self.most, self.tests = folder, allowed, most, []

    def partitions(self) -> list[LandingFile]:
        system, folder = fs.FileSystem.from_uri(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                found.append(LandingFile(info.path, info.base_name, info.extension.lower(), info.size))
        return [f for f in found if all(TESTS[kind](getattr(f, column), value) for column, kind, value in self.tests)]

    def read(self, partition: LandingFile) -> Iterator[tuple]:
        if partition is None or not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        refused = "extension" if self.allowed and partition.extension not in self.allowed else "empty" if partition.length == 0 else "size" if partition.length > self.most else None
        digest = None
        if refused is None:  # a file that is refused is never opened
            sha = hashlib.sha256()
            with system.open_input_stream(partition.path) as file:
                while piece := file.read(1 << 20):
                    sha.update(piece)
            digest = sha.hexdigest()
        yield partition.name, partition.extension, partition.length, digest, refused


class FilteredLandingReader(LandingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what a listing tells are taken; the others are Spark's."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in KNOWN:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f


class LandingSource(DataSource):
    """Options: path (a URI), extensions (comma-separated; without it all are taken), maxBytes, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        wanted = self.options.get("extensions", "")
        kind = FilteredLandingReader if self.options.get("pushdown", "false").lower() == "true" else LandingReader
        return kind(self.options["path"], tuple(x.strip().lower().lstrip(".") for x in wanted.split(",") if x.strip()), int(self.options.get("maxBytes", MAX_BYTES)))
