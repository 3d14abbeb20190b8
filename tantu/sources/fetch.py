"""Fetching by a plug-in: one result row for every url, failures included."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "url string, status int, size_bytes long, sha256 string, content binary, path string, error string"
#: Bytes read at a time.
CHUNK = 262_144


def http_get(url: str, timeout: float = 60.0) -> tuple[int, Iterable[bytes]]:
    """Status and content of a url in chunks, by the standard library; what has no status, as files, is there."""
    import urllib.error
    import urllib.request

    try:
        answer = urllib.request.urlopen(url, timeout=timeout)  # noqa: S310
    except urllib.error.HTTPError as e:
        return e.code, ()
    return answer.status or 200, iter(lambda: answer.read(CHUNK), b"")


def _stored(chunks: Iterable[bytes], folder: str | None) -> tuple[int, str, bytes | None, str | None]:
    """Size, hash, and content or path. Into a folder chunks are written as they come, under another name until all are there."""
    sha, size = hashlib.sha256(), 0
    if folder is None:
        parts = []
        for c in chunks:
            sha.update(c)
            size += len(c)
            parts.append(c)
        return size, sha.hexdigest(), b"".join(parts), None
    part = os.path.join(folder, f"{uuid.uuid4().hex}.part")
    try:
        with open(part, "wb") as f:
            for c in chunks:
                sha.update(c)
                size += len(c)
                f.write(c)
        path = os.path.join(folder, sha.hexdigest())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    return size, sha.hexdigest(), None, path


def fetched(links: DataFrame, get: Callable[[str], tuple[int, bytes | Iterable[bytes]]] = http_get, folder: str | None = None) -> DataFrame:
    """(url, status, size_bytes, sha256, content, path, error) of the distinct urls of links.

    get gives status and content, whole or in chunks; its hash is taken on the way. With a folder, which all executors mount, the content goes
    there under its hash and is never held whole. A status other than 200 to 299 is the error http_<status>, an exception
    status 0 with its name; neither has content. Null urls are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if folder is not None:
            os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    status, content = get(url)
                    if not 200 <= status <= 299:
                        rows.append((url, status, 0, None, None, None, f"http_{status}"))
                        continue
                    size, sha, whole, path = _stored([content] if isinstance(content, bytes) else content, folder)
                    rows.append((url, status, size, sha, whole, path, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, 0, 0, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "status", "size_bytes", "sha256", "content", "path", "error"])

    return links.select("url").filter("url IS NOT NULL").distinct().mapInPandas(run, RESULT)
