"""Keeping an index up with its tree: the system's notices of changes become a change stream, and its settled paths are updated."""

from __future__ import annotations

import ctypes
import json
import os
import select
import struct
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from symloom import shared
from symloom.index import STATE, Index
from symloom.streaming import watch

_MODIFIED, _MOVED_FROM, _MOVED_TO, _CREATED, _DELETED, _FOLDER, _OVERFLOW = 0x2 | 0x8, 0x40, 0x80, 0x100, 0x200, 0x40000000, 0x4000
_EVENT = struct.Struct("iIII")


class Notices:
    """Paths that change below a folder of this machine, as the system tells them; nothing is listed but new folders."""

    def __init__(self, root: str) -> None:
        self.root, self.libc = root, ctypes.CDLL(None, use_errno=True)
        self.fd = self.libc.inotify_init1(os.O_NONBLOCK | os.O_CLOEXEC)
        if self.fd < 0:
            raise OSError(ctypes.get_errno(), "changes can't be watched here")
        self.folders: dict[int, str] = {}
        self._add("")

    def _add(self, folder: str) -> list[str]:
        """Watches a folder and those below it that count; gives the files that are there."""
        out, todo = [], [folder]
        while todo:
            at = todo.pop()
            n = self.libc.inotify_add_watch(self.fd, os.path.join(self.root, at).encode(), _MODIFIED | _MOVED_FROM | _MOVED_TO | _CREATED | _DELETED)
            if n < 0:
                continue  # gone since
            self.folders[n] = at
            try:
                with os.scandir(os.path.join(self.root, at)) as entries:
                    for e in entries:
                        path = f"{at}/{e.name}" if at else e.name
                        if e.is_dir(follow_symlinks=False):
                            if not e.name.startswith(".") and e.name not in watch.IGNORED:
                                todo.append(path)
                        else:
                            out.append(path)
            except FileNotFoundError:
                pass
        return out

    def wait(self, seconds: float) -> list[str]:
        """What has changed since, after at most so long; a path with a slash at its end is a folder that is gone, / alone says that notices were lost."""
        if not select.select([self.fd], [], [], seconds)[0]:
            return []
        try:
            data = os.read(self.fd, 1 << 16)
        except BlockingIOError:
            return []
        out, at = [], 0
        while at < len(data):
            number, mask, _, size = _EVENT.unpack_from(data, at)
            name = data[at + _EVENT.size : at + _EVENT.size + size].rstrip(b"\0").decode("utf-8", "surrogateescape")
            at += _EVENT.size + size
            folder = self.folders.get(number)
            if mask & _OVERFLOW:
                out.append("/")
            elif folder is not None and name:
                path = f"{folder}/{name}" if folder else name
                if not mask & _FOLDER:
                    out.append(path)
                elif mask & (_CREATED | _MOVED_TO):
                    if not name.startswith(".") and name not in watch.IGNORED:
                        out += self._add(path)
                elif mask & (_MOVED_FROM | _DELETED):
                    out.append(path + "/")
        return out

    def close(self) -> None:
        os.close(self.fd)


def tell(spark, folder: str, paths: list[str]) -> None:
    """Drops changes as JSON lines (path, ts) where a stream reads them; an empty path only says what time it is."""
    now = datetime.now(timezone.utc).isoformat()
    name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
    shared.write_text(spark, f"{folder}/.{name}", "".join(json.dumps({"path": p, "ts": now}) + "\n" for p in paths))
    shared.rename(spark, f"{folder}/.{name}", f"{folder}/{name}")


def watch_tree(index: Index, debounce_ms: int = 200, max_batches: int | None = None, on_update: Callable | None = None, timeout: float | None = None) -> int:
    """Updates the index with the paths that have settled, as long as it is let; gives the number of updates.

    What changed before is taken in first. Then only the paths that the system tells of are read; while nothing changes nothing is done. Errors of an
    update are told and the watch goes on. Ends after so many updates, or after timeout seconds.
    """
    spark, done, updates = index.spark, threading.Event(), [0]
    notices = Notices(index.root)
    changes = shared.new_path(spark, "changes")
    gap = max(debounce_ms, 1)

    def took_in(summary) -> None:
        if summary.is_empty or done.is_set():
            return
        updates[0] += 1
        if on_update:
            on_update(summary)
        if max_batches is not None and updates[0] >= max_batches:
            done.set()

    def listen() -> None:
        told: float | None = None  # when changes were told whose runs may still be open
        while not done.is_set():
            quick = told is not None
            paths = sorted({p for p in notices.wait(gap / 1000 if quick else 0.5) if p == "/" or not p.startswith(f"{STATE}/")})
            if paths:
                tell(spark, changes, paths)
                told = time.monotonic()
            elif quick and time.monotonic() - told > 3 * gap / 1000:
                tell(spark, changes, [""])
                told = None

    def settled(paths: list[str], number: int) -> None:
        if not done.is_set():
            took_in(index.update() if "/" in paths else index.update_paths(paths))

    tell(spark, changes, [""])
    events = spark.readStream.schema("path string, ts timestamp").json(changes)
    query = watch.watch(events, settled, shared.new_path(spark, "watch"), f"{gap} milliseconds", stop_on_error=False, every=f"{gap} milliseconds")
    listener = threading.Thread(target=listen, daemon=True)
    listener.start()
    try:
        try:
            took_in(index.update())
        except Exception as e:
            print(f"watch: {e}", flush=True)
        done.wait(timeout)
    finally:
        done.set()
        listener.join()
        query.stop()
        notices.close()
    return updates[0]
