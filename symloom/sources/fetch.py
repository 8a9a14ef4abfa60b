"""Addresses to files: a blob named by its contents, with a note of where it came from."""

from __future__ import annotations

import hashlib
import os
import re
import time
import urllib.parse
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.paths import host, url_extension

MOST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Fetched:
    path: str
    already_present: bool
    n_bytes: int
    sha8: str
    content_hash: bytes


def name_of(url: str, body: bytes) -> tuple[str, str, str]:
    """Folder, first hash digits and extension under which a body is kept."""
    parts = urllib.parse.urlsplit(url)
    if not parts.scheme:
        raise ValueError(f"not an address: {url!r}")
    folder = re.sub(r"[^A-Za-z0-9._-]", "_", parts.hostname or "") or "local"
    last = parts.path.rsplit("/", 1)[-1]
    ext = last.rsplit(".", 1)[-1] if "." in last else ""
    return folder, hashlib.sha256(body).hexdigest()[:8], ext if re.fullmatch(r"[A-Za-z0-9]{1,10}", ext) else "bin"


def _write(path: str, data: bytes) -> None:
    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "wb") as f:
        f.write(data)
    os.replace(staged, path)


def fetch(url: str, into: str) -> Fetched:
    """Reads one address (http, https or file) on the driver and keeps it below into/raw; the same bytes of a host are kept once."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https", "file"):
        raise ValueError(f"not an address that can be read: {url!r}")
    with urllib.request.urlopen(url, timeout=60) as answer:
        body = answer.read(MOST_BYTES)
        kind = None if parts.scheme == "file" else answer.headers.get("Content-Type")
    folder, sha8, ext = name_of(url, body)
    where = os.path.join(into, "raw", folder)
    os.makedirs(where, exist_ok=True)
    path = os.path.join(where, f"{sha8}.{ext}")
    present = os.path.exists(path) and open(path, "rb").read() == body
    if not present:
        _write(path, body)
        _write(os.path.join(where, f"{sha8}.meta"), f"url={url}\nfetched_at={int(time.time())}\ncontent_type={kind or 'unknown'}\nbytes={len(body)}\n".encode())
    return Fetched(path, present, len(body), sha8, hashlib.sha256(body).digest())


def named(pages: DataFrame, key: str, url: str = "url", body: str = "html") -> DataFrame:
    """Pages that were fetched already, as they would be kept: one row for each (host, sha8, ext), its least key, and how many pages they are."""
    rows = pages.select(host(F.col(url)).alias("host"), F.substring(F.sha2(F.col(body), 256), 1, 8).alias("sha8"), url_extension(F.col(url)).alias("ext"), key)
    return rows.groupBy("host", "sha8", "ext").agg(F.min(key).alias(key), F.count("*").alias("pages"))
