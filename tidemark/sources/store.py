"""A namespace of objects under relative keys, on any Hadoop file system."""

from __future__ import annotations

import io
import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, guarded, invalid
from ..operators import telemetry

# Bounds and defaults of a store.
MAX_RANGE_BYTES = 8 * 1024 * 1024
S3_DEFAULTS = {"region": "us-east-1", "path_style": False, "tls": True, "max_range_bytes": MAX_RANGE_BYTES, "request_timeout": 30_000, "max_retries": 3, "max_concurrency": 4, "multipart_part_size": 8 * 1024 * 1024, "multipart_in_flight": 2, "credential_provider": "standard"}
S3_BOUNDS = {"max_range_bytes": (1, 1 << 32), "request_timeout": (1, 3_600_000), "max_retries": (0, 100), "max_concurrency": (1, 1024), "multipart_part_size": (5 * 1024 * 1024, 512 * 1024 * 1024), "multipart_in_flight": (1, 64)}
S3_KEYS = {*S3_DEFAULTS, "bucket", "prefix", "endpoint", "access_key_id", "secret_access_key", "session_token"}
SECRET_KEYS = {"access_key_id", "secret_access_key", "session_token"}

_ids = itertools.count(1)
_active: dict[str, int] = {"readers": 0, "writers": 0}


@dataclass(frozen=True)
class Metadata:
    key: str
    size: int
    modified_unix_ns: int


def checked_key(key, operation: str, empty: bool = False) -> str:
    """A relative key as it is; an error for anything that could leave the store."""
    if not isinstance(key, str) or (not key and not empty):
        raise invalid(operation, "a key must be non-empty text")
    if not key:
        return key
    parts = key.split("/")
    if key.startswith("/") or "\\" in key or "\0" in key or re.match(r"[A-Za-z]:", key) or any(p in ("", ".", "..") for p in parts):
        raise invalid(operation, "a key must be relative, without empty, . or .. segments")
    return key


def s3_settings(**options) -> tuple[str, dict[str, str]]:
    """The root URI of a bucket and the ``fs.s3a.bucket`` settings that a store's options mean."""
    if unknown := set(options) - S3_KEYS:
        raise invalid("open", f"unknown options: {len(unknown)}")
    o = S3_DEFAULTS | options
    if not isinstance(o.get("bucket"), str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]{1,61}[A-Za-z0-9]", o["bucket"]):
        raise invalid("open", "bucket must be a bucket's name")
    for name, (low, high) in S3_BOUNDS.items():
        if isinstance(o[name], bool) or not isinstance(o[name], int) or not low <= o[name] <= high:
            raise invalid("open", f"{name} is out of range")
    endpoint = o.get("endpoint")
    if endpoint is not None:
        m = re.fullmatch(r"(https?)://([A-Za-z0-9.-]+|\[[0-9A-Fa-f:]+\])(:\d{1,5})?", endpoint) if isinstance(endpoint, str) else None
        if not m:
            raise invalid("open", "endpoint must be an http or https origin without path, query or user")
        if (m[1] == "https") != o["tls"]:
            raise invalid("open", "endpoint and tls disagree")
    keyed = o.get("access_key_id") is not None or o.get("secret_access_key") is not None
    provider = "explicit" if keyed and "credential_provider" not in options else o["credential_provider"]
    if provider not in ("standard", "explicit"):
        raise invalid("open", "credential_provider must be standard or explicit")
    if provider == "explicit" and not (o.get("access_key_id") and o.get("secret_access_key")):
        raise invalid("open", "explicit credentials need access_key_id and secret_access_key")
    if provider == "standard" and keyed:
        raise invalid("open", "standard credentials take no keys")
    own = {
        "endpoint.region": o["region"],
        "path.style.access": str(o["path_style"]).lower(),
        "connection.ssl.enabled": str(o["tls"]).lower(),
        "connection.timeout": str(o["request_timeout"]),
        "attempts.maximum": str(o["max_retries"] + 1),
        "connection.maximum": str(o["max_concurrency"]),
        "multipart.size": str(o["multipart_part_size"]),
        "fast.upload.active.blocks": str(o["multipart_in_flight"]),
    }
    if endpoint:
        own["endpoint"] = endpoint
    if provider == "explicit":
        own |= {"access.key": o["access_key_id"], "secret.key": o["secret_access_key"], "aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"}
        if o.get("session_token"):
            own |= {"session.token": o["session_token"], "aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"}
    # of this bucket alone, so that stores with other credentials can be open beside it
    conf = {f"fs.s3a.bucket.{o['bucket'].lower()}.{k}": v for k, v in own.items()}
    prefix = checked_key(o.get("prefix") or "", "open", empty=True)
    return f"s3a://{o['bucket'].lower()}" + (f"/{prefix}" if prefix else ""), conf


@dataclass(frozen=True)
class Store:
    spark: SparkSession = field(repr=False)
    uri: str = field(repr=False)
    backend: str = "local"
    max_range_bytes: int = MAX_RANGE_BYTES
    identity: int = field(default_factory=lambda: next(_ids))

    # --- opening

    @classmethod
    def open(cls, spark: SparkSession, backend: str, root: str | None = None, **options) -> Store:
        """``local``: a folder that exists, or any URI that Spark reads. ``s3``: a bucket; its settings go to the session's Hadoop configuration."""
        if backend == "s3":
            uri, conf = s3_settings(**options)
            hadoop = spark.sparkContext._jsc.hadoopConfiguration()
            for k, v in conf.items():
                hadoop.set(k, v)
            return cls(spark, uri, "s3", options.get("max_range_bytes", MAX_RANGE_BYTES))
        if backend != "local":
            raise invalid("open", "backend must be local or s3")
        if set(options) - {"max_range_bytes"}:
            raise invalid("open", "unknown options")
        most = options.get("max_range_bytes", MAX_RANGE_BYTES)
        if isinstance(most, bool) or not isinstance(most, int) or not 1 <= most <= 1 << 32:
            raise invalid("open", "max_range_bytes is out of range")
        if not isinstance(root, str) or not root:
            raise invalid("open", "a local store needs a root folder")
        store = cls(spark, root.rstrip("/") or "/", "local", most)
        with guarded("open"):
            path = store._jpath("")
            if not store._fs().exists(path):
                raise EngineError("not_found", "open", "the root does not exist")
            if not store._fs().getFileStatus(path).isDirectory():
                raise invalid("open", "the root is not a folder")
        return store

    # --- paths

    def path(self, key: str = "") -> str:
        return f"{self.uri}/{key}" if key else self.uri

    def _jpath(self, key: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key))

    def _fs(self):
        return self._jpath("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _status(self, key: str, operation: str):
        with guarded(operation):
            fs, path = self._fs(), self._jpath(key)
            if self.backend == "local" and not self._inside(path):
                raise EngineError("permission_denied", operation, "object access was denied")
            if not fs.exists(path) or fs.getFileStatus(path).isDirectory():
                raise EngineError("not_found", operation, "object not found")
            return fs.getFileStatus(path)

    def _inside(self, path) -> bool:
        """Whether a local path stays under the root once links are followed."""
        uri = self._fs().makeQualified(path).toUri()
        if uri.getScheme() != "file":
            return True
        import os

        real, root = os.path.realpath(uri.getPath()), os.path.realpath(self._fs().makeQualified(self._jpath("")).toUri().getPath())
        return real == root or real.startswith(root.rstrip("/") + "/")

    # --- objects

    def head(self, key: str) -> Metadata:
        key = checked_key(key, "head")
        s = self._status(key, "head")
        return Metadata(key, s.getLen(), s.getModificationTime() * 10**6)

    def read_range(self, key: str, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes; fewer at the end of the object."""
        key = checked_key(key, "read_range")
        if any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in (offset, length)):
            raise invalid("read_range", "offset and length must be whole numbers")
        if length > self.max_range_bytes:
            raise invalid("read_range", "the range is longer than max_range_bytes")
        size = self._status(key, "read_range").getLen()
        if offset > size:
            raise invalid("read_range", "the range begins beyond the object's end")
        n = min(length, size - offset)
        telemetry.emit(("storage",), {"range_requests": 1, "bytes": n}, {"operation": "read_range", "backend": self.backend, "source_count": 1})
        if not n:
            return b""
        with guarded("read_range"):
            stream = self._fs().open(self._jpath(key))
            try:
                stream.seek(offset)
                return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            finally:
                stream.close()

    def read(self, key: str) -> bytes:
        size = self.head(key).size
        return b"".join(self.read_range(key, at, min(self.max_range_bytes, size - at)) for at in range(0, size, self.max_range_bytes))

    def list(self, prefix: str = "") -> list[Metadata]:
        """All files under a prefix (whole segments), by key; links and hidden staging files are left out."""
        prefix = checked_key(prefix.rstrip("/") if isinstance(prefix, str) else prefix, "list", empty=True)
        with guarded("list"):
            fs, top = self._fs(), self._jpath(prefix)
            if not fs.exists(top):
                return []
            root = fs.makeQualified(self._jpath("")).toUri().getPath().rstrip("/") + "/"
            out = []
            if fs.getFileStatus(top).isDirectory():
                found = fs.listFiles(top, True)
                while found.hasNext():
                    s = found.next()
                    key = s.getPath().toUri().getPath().removeprefix(root)
                    if any(p.startswith((".", "_")) for p in key.split("/")) or self.backend == "local" and not self._inside(s.getPath()):
                        continue
                    out.append(Metadata(key, s.getLen(), s.getModificationTime() * 10**6))
        telemetry.emit(("storage",), {"objects": len(out)}, {"operation": "list", "backend": self.backend, "source_count": 1})
        return sorted(out, key=lambda m: m.key.encode())

    def listing(self, prefix: str = ""):
        """The listing as a DataFrame (key, size, modified), by Spark's own distributed listing."""
        prefix = checked_key(prefix.rstrip("/"), "list", empty=True)
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(prefix))
        root = self._fs().makeQualified(self._jpath("")).toUri().getPath().rstrip("/") + "/"
        return df.select(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^" + re.escape(root), "").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def delete(self, key: str) -> None:
        key = checked_key(key, "delete")
        self._status(key, "delete")
        with guarded("delete"):
            self._fs().delete(self._jpath(key), False)

    def put(self, key: str, chunks) -> Metadata:
        """Bytes, or nested lists of them, as one object; an older one is replaced."""
        writer = self.open_writer(key)
        try:
            for piece in _pieces(chunks):
                writer.write(piece)
            return writer.publish()
        except BaseException:
            writer.cancel()
            raise

    def open_writer(self, key: str) -> ObjectWriter:
        return ObjectWriter(self, checked_key(key, "put"))

    def move(self, source: str, key: str, over: bool = True) -> None:
        """A staged object or folder (a path under this store) to its key, over an older one or only where there is none."""
        self.mover()(source, key, over)

    def mover(self) -> Callable[..., None]:
        """``move`` for many objects, also by threads: what each needs of the JVM is fetched once."""
        with guarded("put"):
            jvm = self.spark._jvm
            fs = self._fs()
            root = fs.makeQualified(self._jpath(""))
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            rename, new_path = jvm.org.apache.hadoop.fs.Options.Rename, jvm.org.apache.hadoop.fs.Path
            options = {}
            for over in (True, False):
                options[over] = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[over][0] = rename.OVERWRITE if over else rename.NONE
            root = root.toString().rstrip("/")
        made: set[str] = set()

        def move(source: str, key: str, over: bool = True) -> None:
            with guarded("put"):
                target, folder = new_path(f"{root}/{key}"), key.rpartition("/")[0]
                if folder not in made:
                    fs.mkdirs(target.getParent())
                    made.add(folder)
                context.rename(new_path(f"{root}/{source}"), target, options[over])

        return move

    def remove_tree(self, key: str) -> None:
        with guarded("delete"):
            self._fs().delete(self._jpath(checked_key(key, "delete")), True)


def _pieces(chunks) -> Iterator[bytes]:
    if isinstance(chunks, (bytes, bytearray, memoryview)):
        yield bytes(chunks)
    elif isinstance(chunks, str):
        yield chunks.encode()
    elif isinstance(chunks, Iterable):
        for c in chunks:
            yield from _pieces(c)
    else:
        raise invalid("put", "the content must be bytes")


class ObjectWriter:
    """Writes a hidden sibling; ``publish`` moves it to the key, ``cancel`` leaves the older object as it is."""

    def __init__(self, store: Store, key: str):
        self.store, self.key = store, key
        folder, _, name = key.rpartition("/")
        self.staged = f"{folder}/" * bool(folder) + f".{name}.{uuid.uuid4().hex}"
        self.open = True
        with guarded("put"):
            self._out = store._fs().create(store._jpath(self.staged), False)
        _active["writers"] += 1

    def write(self, data: bytes) -> None:
        if not self.open:
            raise invalid("put", "the writer is closed")
        with guarded("put"):
            for at in range(0, len(data), 1 << 20):
                self._out.write(bytearray(data[at : at + (1 << 20)]))

    def _end(self) -> None:
        self.open = False
        _active["writers"] -= 1
        self._out.close()

    def publish(self) -> Metadata:
        if not self.open:
            raise invalid("put", "the writer is closed")
        with guarded("put"):
            self._end()
        self.store.move(self.staged, self.key)
        m = self.store.head(self.key)
        telemetry.emit(("storage",), {"objects": 1, "bytes": m.size}, {"operation": "put", "backend": self.store.backend, "source_count": 1})
        return m

    def cancel(self) -> None:
        if self.open:
            try:
                self._end()
                self.store._fs().delete(self.store._jpath(self.staged), False)
            except Py4JError:
                pass
            telemetry.emit(("cancellation",), {"cancellations": 1}, {"kind": "writer", "backend": self.store.backend, "source_count": 1})


class StoreFile(io.RawIOBase):
    """An object as a seekable file that reads ranges; for readers of footers."""

    def __init__(self, store: Store, key: str):
        self.store, self.key, self.at = store, key, 0
        self.size = store.head(key).size
        self.requests = self.bytes = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = {0: 0, 1: self.at, 2: self.size}[whence] + offset
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        out = []
        while n > 0:
            piece = self.store.read_range(self.key, self.at, min(n, self.store.max_range_bytes))
            if not piece:
                break
            out.append(piece)
            self.at += len(piece)
            n -= len(piece)
            self.requests += 1
            self.bytes += len(piece)
        return b"".join(out)

    def readall(self) -> bytes:
        return self.read()


def resource_snapshot() -> dict[str, int]:
    """Readers and writers that are open in this process."""
    return dict(_active)


def status(spark: SparkSession) -> dict:
    """Whether the session answers."""
    with guarded("status"):
        return {"ok": spark.range(1).count() == 1, "engine": spark.version, "api_version": 2}


def error_probe() -> None:
    raise EngineError("native_failure", "error_probe", "the probe failed as asked")
