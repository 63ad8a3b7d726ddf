"""Stored objects as a data source of Spark: batch and stream, read by ranges of keys.

    spark.dataSource.register(ObjectSource)
    spark.read.format("objects").option("path", "/data/papers").load()

A store lists its keys in order, a page at a time, and gives an object's bytes. ``FolderStore`` is a folder that all machines
share, ``HttpStore`` a listing with one address a line; option ``store`` names a class of your own (module:Class), made with ``path``.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "storage_key string, bytes long, mime string, content binary"
# Kinds of files by their first bytes, and by the end of their names.
MAGIC = [(b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"PK\x03\x04", "application/zip"), (b"GIF8", "image/gif")]
SUFFIXES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "csv": "text/csv", "txt": "text/plain", "json": "application/json", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def mime_of(key: str, head: bytes, said: str | None = None) -> str:
    """What an object is: by its first bytes, else as its store says, else by its name. An office file is a zip by its bytes and goes by its name."""
    by_name = SUFFIXES.get(key.rpartition(".")[2].lower())
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp"
    by_bytes = next((m for b, m in MAGIC if head.startswith(b)), None)
    if by_bytes == "application/zip" and by_name:
        return by_name
    return by_bytes or (said or "").split(";")[0].strip() or by_name or "application/octet-stream"


class FolderStore:
    """The files of a folder and those below, by their path within it."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _walk(self, folder: str, after: str) -> Iterator[str]:
        # names in the order of their whole keys: a folder sorts as its name with a slash
        entries = sorted((e.name + "/" if e.is_dir() else e.name) for e in os.scandir(f"{self.path}/{folder}" if folder else self.path))
        for name in entries:
            key = folder + name
            if name.endswith("/"):
                if key > after or after.startswith(key):
                    yield from self._walk(key, after)
            elif key > after:
                yield key

    def keys(self, after: str, most: int) -> list[str]:
        found = []
        for key in self._walk("", after):
            found.append(key)
            if len(found) == most:
                break
        return found

    def get(self, key: str) -> tuple[bytes, str | None]:
        with open(f"{self.path}/{key}", "rb") as f:
            return f.read(), None


class HttpStore:
    """Addresses that a listing names, one a line; relative ones go by the listing's."""

    def __init__(self, path: str):
        self.path = path
        self._keys: list[str] | None = None

    def keys(self, after: str, most: int) -> list[str]:
        from urllib.request import urlopen

        if self._keys is None:
            with urlopen(self.path, timeout=60) as r:
                self._keys = sorted({line.strip() for line in r.read().decode().splitlines() if line.strip()})
        return [k for k in self._keys if k > after][:most]

    def get(self, key: str) -> tuple[bytes, str | None]:
        from urllib.parse import urljoin
        from urllib.request import urlopen

        with urlopen(urljoin(self.path, key), timeout=60) as r:
            return r.read(), r.headers.get("Content-Type")


class Range(InputPartition):
    def __init__(self, after: str, last: str):
        self.after, self.last = after, last


class _Reading:
    def __init__(self, options: dict):
        self.path, self.prefix, self.size = options["path"], options.get("prefix", ""), int(options.get("rangesize", "1000"))
        self.with_content = options.get("content", "true").lower() != "false"
        module, _, name = options.get("store", "gradeloom.sources.objects:FolderStore").partition(":")
        self.module, self.name = module, name

    def store(self):
        return getattr(importlib.import_module(self.module), self.name)(self.path)

    def pages(self, after: str, last: str | None = None) -> Iterator[list[str]]:
        """Keys with the prefix, behind ``after`` up to ``last``, a page at a time."""
        store = self.store()
        after = max(after, self.prefix[:-1] + chr(ord(self.prefix[-1]) - 1) + chr(0x10FFFF) if self.prefix and ord(self.prefix[-1]) > 0 else "")
        while page := store.keys(after, self.size):
            after = page[-1]
            kept = [k for k in page if k.startswith(self.prefix) and (last is None or k <= last)]
            if kept:
                yield kept
            if (last is not None and after >= last) or (not after.startswith(self.prefix) and after > self.prefix):
                return

    def ranges(self, after: str, last: str | None = None) -> list[Range]:
        """A range a page; only its ends are held."""
        out = []
        for page in self.pages(after, last):
            out.append(Range(after, page[-1]))
            after = page[-1]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store = self.store()
        for page in self.pages(partition.after, partition.last):
            for key in page:
                data, said = store.get(key)
                yield key, len(data), mime_of(key, data[:16], said), data if self.with_content else None


class ObjectReader(_Reading, DataSourceReader):
    def partitions(self):
        return self.ranges("") or [Range("", "")]


class ObjectStreamReader(_Reading, DataSourceStreamReader):
    """New objects have larger keys than all before them, as dated ones do; each is given once."""

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        last = getattr(self, "_last", "")
        for page in self.pages(last):
            last = page[-1]
        self._last = last
        return {"after": last}

    def partitions(self, start, end):
        return self.ranges(start["after"], end["after"]) if end["after"] > start["after"] else []

    def commit(self, end):
        pass


class ObjectSource(DataSource):
    """(storage_key, bytes, mime, content) of a store's objects. Options: path, prefix, store, rangesize (objects a task), content (false: none is handed on)."""

    @classmethod
    def name(cls):
        return "objects"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ObjectReader(self.options)

    def streamReader(self, schema):
        return ObjectStreamReader(self.options)
