"""File access from inside tasks."""

from __future__ import annotations

from functools import lru_cache

from tallystar.tasks import ship_by_value

ship_by_value(__name__)

# Hadoop's names of stores that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@lru_cache
def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def arrow_location(path: str):
    """Arrow file system and inner path of a path as Spark writes it; the part after the host is taken as it is."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, slash, inner = rest.removeprefix("//").partition("/")
    system, base = _system(f"{_SCHEMES.get(scheme, scheme)}://{host}")
    return system, base.rstrip("/") + slash + inner


def open_bytes(path: str):
    """A seekable binary stream; the default opener of the readers, which take any function like it."""
    system, inner = arrow_location(path)
    return system.open_input_file(inner)
