"""A store of files by document and version as a data source that reads and writes: originals, pictures, table grids.

The store is a folder that driver and executors mount alike (``path``, plain or ``file:``); other stores are the engine's own writers' business.  A file's key is
``doc/version/name``, ``doc/version/images/<sha256><suffix>`` or ``doc/version/tables/<name>.json``; names keep letters, digits, Han
characters, ``.``, ``-`` and ``_``.  Tasks write into a staging folder of their job, and the commit moves what they wrote to its place; if
a task fails, the job's staging folder goes and nothing of it is ever visible (what other tasks of it still wrote then stays in staging, which readers never look at, until ``sweep``).  A key that leads out of the store fails its task.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "doc_id string, version_id string, kind string, name string, content binary"
KINDS = ("file", "image", "table")
#: Fixed value: characters that names don't keep.
_ODD = re.compile(r"[^\w.\-一-鿿]")
_STAGING = ".staging"


def local_root(path: str) -> str:
    root = re.sub(r"^file:/+", "/", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", root):
        raise ValueError(f"not a mounted folder: {path}")
    return os.path.realpath(root)


def key_of(doc_id: str, version_id: str, kind: str, name: str, content: bytes) -> str:
    """The file's key; ValueError if it isn't one."""
    base = os.path.basename(name or "")
    if kind == "image":
        last = f"images/{hashlib.sha256(content).hexdigest()}{os.path.splitext(base)[1]}"
    elif kind in KINDS:
        last = ("tables/{}.json" if kind == "table" else "{}").format(_ODD.sub("_", base))
    else:
        raise ValueError(f"kind {kind!r}")
    for part in (doc_id, version_id):
        if not part or part.startswith(".") or "/" in part or "\\" in part or "\0" in part:
            raise ValueError(f"not a key: {doc_id!r}, {version_id!r}")
    if last in ("", ".", ".."):
        raise ValueError(f"not a name: {name!r}")
    return f"{doc_id}/{version_id}/{last}"


@dataclass
class _Version(InputPartition):
    doc_id: str
    version_id: str


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only = root, {}

    def pushFilters(self, filters):
        """Equality and ``in`` on doc_id and version_id choose folders; all else is left to the engine."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("doc_id",), ("version_id",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        inside = lambda at, only: sorted(n for n in (os.listdir(at) if only is None else only) if n and not n.startswith(".") and os.path.isdir(os.path.join(at, n)))
        docs = inside(self.root, self.only.get("doc_id")) if os.path.isdir(self.root) else []
        return [_Version(d, v) for d in docs for v in inside(f"{self.root}/{d}", self.only.get("version_id"))]

    def read(self, partition):
        if partition is None:  # a store without files
            return
        at = f"{self.root}/{partition.doc_id}/{partition.version_id}"
        for kind, folder in (("file", at), ("image", f"{at}/images"), ("table", f"{at}/tables")):
            for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
                if os.path.isfile(f"{folder}/{name}"):
                    with open(f"{folder}/{name}", "rb") as f:
                        yield partition.doc_id, partition.version_id, kind, name, f.read()


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    """Moves happen on the driver, one rename a file; contents never pass through it."""

    def __init__(self, root: str):
        self.root = root
        self.job = f"{root}/{_STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator):
        folder, n = f"{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            content = bytes(row["content"] or b"")
            to = os.path.join(folder, key_of(row["doc_id"], row["version_id"], row["kind"], row["name"], content))
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(content)
            n += 1
        return _Staged(folder, n)

    def commit(self, messages, batchId=None):
        for m in messages:
            if m is None or not m.files:
                continue
            for at, _, names in os.walk(m.folder):
                to = os.path.join(self.root, os.path.relpath(at, m.folder))
                if names:
                    os.makedirs(to, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(at, name), os.path.join(to, name))
        self._clear()

    def abort(self, messages, batchId=None):
        self._clear()

    def _clear(self):
        shutil.rmtree(self.job, ignore_errors=True)


class _StreamWriter(_Writer, DataSourceStreamWriter):
    """A batch that comes again writes the same keys again."""


class StoredObjects(DataSource):
    """``df.write.format("stored_objects").mode("append").save(path)``, ``spark.read.format("stored_objects").load(path)``, and ``writeStream``."""

    @classmethod
    def name(cls):
        return "stored_objects"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(local_root(self.options["path"]))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("the store only takes more files; drop versions with drop_assets")
        return _Writer(local_root(self.options["path"]))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(local_root(self.options["path"]))


def store(files: DataFrame, path: str) -> None:
    """Write files (doc_id, version_id, kind, name, content), all or none."""
    files.sparkSession.dataSource.register(StoredObjects)
    files.select("doc_id", "version_id", "kind", "name", "content").write.format("stored_objects").mode("append").save(path)


def stored(spark, path: str) -> DataFrame:
    """All files of a store; conditions on doc_id and version_id choose the folders that are read."""
    spark.dataSource.register(StoredObjects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stored_objects").load(path)


def drop_assets(path: str, doc_id: str, version_id: str) -> None:
    """Remove the pictures and tables derived from one version; its original stays."""
    at = f"{local_root(path)}/{os.path.dirname(key_of(doc_id, version_id, 'file', 'x', b''))}"
    for folder in ("images", "tables"):
        shutil.rmtree(f"{at}/{folder}", ignore_errors=True)


def sweep(path: str, hours: float = 24) -> None:
    """Remove staging folders of jobs that began over ``hours`` ago."""
    staging = f"{local_root(path)}/{_STAGING}"
    for job in os.listdir(staging) if os.path.isdir(staging) else []:
        if time.time() - os.path.getmtime(f"{staging}/{job}") >= hours * 3600:
            shutil.rmtree(f"{staging}/{job}", ignore_errors=True)
