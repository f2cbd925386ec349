"""Small files beside tables: atomic put-if-absent, read and list, on whatever store a path names."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path on this machine where the store is the local one, as in tests or on a mounted shared folder."""
    at = urlparse(path)
    return unquote(at.path) if at.scheme == "file" else None


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, which the session's default file system decides where none is given."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole small file that nobody has written before; False if it is there. Readers see all of it or nothing.

    On the local file system a link to a finished file can't replace another one; elsewhere a rename that may not overwrite.
    """
    path = qualified(spark, path)
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        handle, made = tempfile.mkstemp(prefix=".new-", dir=os.path.dirname(local))
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.link(made, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
    fs = spark._jvm.org.apache.hadoop.fs
    final = fs.Path(path)
    made = fs.Path(final.getParent(), f".new-{os.urandom(8).hex()}")
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(final.getParent())
    out = store.create(made, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = spark._sc._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.NONE
    try:
        fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(made, final, options)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        store.delete(made, False)
        return False


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder; hidden ones are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        return []
    return sorted(n for s in store.listStatus(p) if not (n := s.getPath().getName()).startswith("."))
