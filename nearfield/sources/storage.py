"""Files of a collection: write-once segment directories and a manifest that a rename commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FORMAT_VERSION = 1
MANIFEST = "manifest.json"
NUMBERS = ("format_version", "dim", "segment_capacity", "m", "ef_construction", "segment_count")


class Store:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(*parts))

    def fresh(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Replaces the manifest."""
        self.replace(json.dumps(manifest, indent=1).encode(), MANIFEST)

    def write_bytes(self, raw: bytes, *parts: str) -> None:
        out = self._fs.create(self._path(*parts), True)
        try:
            for at in range(0, len(raw), 1 << 24):
                out.write(bytearray(raw[at : at + (1 << 24)]))
        finally:
            out.close()

    def replace(self, raw: bytes, name: str) -> None:
        """Writes a file by a temporary one and one rename over the old one."""
        temp = f".{name}.{uuid.uuid4().hex}.tmp"
        self.write_bytes(raw, temp)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(temp), self._fs.makeQualified(self._path(name)), over)

    def manifest(self) -> dict:
        """The checked manifest; RuntimeError where it is missing or malformed."""
        if not self.exists(MANIFEST):
            raise RuntimeError(f"no {MANIFEST} in {self.path}")
        try:
            found = json.loads(self.read_text(MANIFEST))
        except ValueError as e:
            raise RuntimeError(f"{MANIFEST} is not JSON") from e
        if not isinstance(found, dict):
            raise RuntimeError(f"{MANIFEST} is not an object")
        for name in NUMBERS:
            value = found.get(name)
            if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**64:
                raise RuntimeError(f"{MANIFEST}: {name} is missing or not an unsigned integer")
        if found["format_version"] != FORMAT_VERSION:
            raise RuntimeError(f"{MANIFEST}: unknown format version {found['format_version']}")
        segments = found.get("segments")
        if not isinstance(segments, list) or len(segments) != found["segment_count"]:
            raise RuntimeError(f"{MANIFEST}: segments and segment_count differ")
        for s in segments:
            if not isinstance(s, dict) or not isinstance(s.get("dir"), str) or not all(isinstance(s.get(x), int) and s[x] >= 0 for x in ("segment_id", "rows")):
                raise RuntimeError(f"{MANIFEST}: a malformed segment")
        return found
