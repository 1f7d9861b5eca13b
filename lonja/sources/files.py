"""Files through the Hadoop file system that Spark is set up with, so local paths and URLs are treated alike."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

BLOCK = 1 << 20


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    size: int
    modified: int


class Files:
    """The file systems of a session's Hadoop configuration."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def list(self, path: str, recursive: bool = True) -> list[Entry]:
        """The data files below ``path`` (hidden ones left out), by path; none if it does not exist."""
        fs, p = self._at(path)
        out = []
        if fs.exists(p):
            it = fs.listFiles(p, recursive)
            while it.hasNext():
                f = it.next()
                if not f.getPath().getName().startswith((".", "_")):
                    out.append(Entry(f.getPath().toString(), f.getPath().getName(), f.getLen(), f.getModificationTime()))
        return sorted(out, key=lambda e: e.path)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; FALSE, and nothing is written, if the path is taken. The check and the creation are one step."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig")
        finally:
            stream.close()

    def write_json(self, path: str, value: object) -> None:
        self.write_text(path, json.dumps(value, ensure_ascii=False, indent=1, default=str))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        """Copies a file to a new path; the copy appears whole or not at all."""
        (a, p), (b, q) = self._at(source), self._at(target)
        part = self._jvm.org.apache.hadoop.fs.Path(q.getParent(), f"_{q.getName()}.part")
        b.mkdirs(q.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, part, False, True, self._conf)
        if b.exists(q) or not b.rename(part, q):
            b.delete(part, False)
            raise OSError(f"{target} can't be created")

    def sha256(self, path: str) -> str:
        """SHA-256 of a file, streamed in the JVM, a block at a time."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def fingerprint(self, path: str) -> str:
        """SHA-256 over the sorted sizes, times and names of the files below ``path``."""
        lines = sorted(f"{e.size}|{e.modified}|{e.name}" for e in self.list(path))
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def normal(path: str) -> tuple[str, str]:
    """(scheme and host, path without dots) of a path or URL; a path without scheme is a local one."""
    u = urlsplit(path) if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:/", path) else urlsplit(f"file:{posixpath.abspath(path)}")
    return f"{u.scheme.lower()}://{u.netloc.lower()}", posixpath.normpath("/" + u.path.lstrip("/"))


def is_below(path: str, folder: str) -> bool:
    """Whether ``path`` lies below ``folder``, itself left out."""
    (a, p), (b, f) = normal(path), normal(folder)
    return a == b and p != f and p.startswith(f.rstrip("/") + "/")
