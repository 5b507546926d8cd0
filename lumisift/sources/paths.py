"""File systems behind Hadoop-style URIs, for Python on driver and executors."""

from __future__ import annotations

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of ``uri``, the path inside it, and what to put before a
    path of it to get a URI again (nothing for local files)."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri, ""
    scheme, _, rest = uri.partition("://")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path, uri[: len(uri) - len(path.lstrip("/"))] if rest.endswith(path.lstrip("/")) else f"{scheme}://"


def same_path(path: str) -> str:
    """One spelling of a local path or URI, as listings give it."""
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path
