"""Small files beside tables, on any file system that Spark reaches: read whole, and replaced in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that readers and one writer share. What ``replace`` writes is seen whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _place(self, name: str):
        place = self.jvm.org.apache.hadoop.fs.Path(self.path(name))
        return place, place.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        place, fs = self._place(name)
        return fs.exists(place)

    def is_folder(self) -> bool:
        place, fs = self._place("")
        return fs.exists(place) and fs.getFileStatus(place).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """What lies in a sub-folder, in order; none if it is missing."""
        place, fs = self._place(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    def read(self, name: str) -> str | None:
        place, fs = self._place(name)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file, then rename over it: a writer that dies before leaves the old file as it was."""
        place, fs = self._place(name)
        beside, _ = self._place(f".{name.replace('/', '_')}-{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.mkdirs(place.getParent())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(beside), fs.makeQualified(place), options)

    def delete(self, name: str) -> None:
        place, fs = self._place(name)
        fs.delete(place, True)

    def read_json(self, name: str) -> dict | None:
        text = self.read(name)
        return None if text is None else json.loads(text)

    def replace_json(self, name: str, value: dict) -> None:
        self.replace(name, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
