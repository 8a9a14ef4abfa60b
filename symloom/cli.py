"""The command line: python -m symloom.cli VERB ..., or a path to index."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from symloom import render
from symloom.index import Index
from symloom.operators import meter as meter_ops
from symloom.sources import counters
from symloom.operators.lookup import Ambiguous

VERBS = ["init", "index", "update", "query", "follow", "refs", "slice", "add", "path", "explain", "map", "meter", "watch", "serve"]


class Refused(Exception):
    """A verb that can't be done: exit 1."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("symloom")
    sub = p.add_subparsers(dest="verb", required=True)
    verb = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a, **k) for a, k in args]
    verb("init", (["path"], {"nargs": "?"}), (["--no-gitignore"], {"action": "store_true"}))
    verb("index")
    verb("update")
    verb("query", (["question"], {}), (["--dfs"], {"action": "store_true"}), (["--budget"], {"type": int, "default": 2000}))
    verb("follow", (["symbol"], {}), (["--from"], {"dest": "at"}), (["--budget"], {"type": int, "default": 2000}))
    verb("refs", (["symbol"], {}), (["--limit"], {"type": int, "default": 20}))
    verb("slice", (["location"], {}), (["--budget"], {"type": int, "default": 2000}))
    verb("add", (["url"], {}))
    verb("path", (["start"], {}), (["goal"], {}))
    verb("explain", (["symbol"], {}))
    verb("map", (["--scope"], {}), (["--depth"], {"type": int, "default": 2}))
    verb("meter", (["--json"], {"action": "store_true"}), (["--since"], {}), (["--reset"], {"action": "store_true"}), (["--diff"], {"action": "store_true"}), (["--record-input"], {"type": int}), (["--record-output"], {"type": int}))
    verb("watch", (["--debounce"], {"type": int, "default": 200}), (["--max-batches"], {"type": int}))
    verb("serve")
    return p


def main(args: list[str], root: str = ".", spark=None, out=None) -> int:
    """0 if done, 1 if the verb failed, 2 if the words made no sense."""
    if args and args[0] not in VERBS and not args[0].startswith("-"):
        if not os.path.isdir(args[0]):
            print(f"neither a verb nor a folder: {args[0]}", file=sys.stderr)
            return 2
        root, args = args[0], ["update" if "--update" in args[1:] else "index"]
    try:
        a = parser().parse_args(args)
        since = meter_ops.duration_seconds(a.since) if a.verb == "meter" and a.since else None
        if a.verb == "slice":
            path, _, line = a.location.rpartition(":")
            if not path or not line.isdigit():
                raise ValueError("a location is FILE:LINE")
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    say = lambda text: print(text, end="" if text.endswith("\n") else "\n", file=out or sys.stdout)
    try:
        if a.verb == "meter":
            say(_meter(a, os.path.join(os.path.abspath(root), ".symloom"), since))
            return 0
        if spark is None:
            from symloom.session import session

            spark = session("local[*]")
        ix = Index(spark, getattr(a, "path", None) or root)
        say(_run(a, ix))
    except (Refused, Ambiguous, ValueError, OSError) as e:
        print(f"symloom {a.verb}: {e}", file=sys.stderr)
        return 1
    return 0


def _meter(a, folder: str, since: int | None) -> str:
    state = counters.read(folder)
    if a.reset:
        counters.write(folder, counters.reset(state))
        return "meter reset"
    if a.record_input is not None or a.record_output is not None:
        counters.write(folder, counters.record(state, max(a.record_input or 0, 0), max(a.record_output or 0, 0)))
        return ""
    if a.json:
        shown = counters.difference(state) if a.diff else {c: state[c] for c in meter_ops.COUNTERS}
        text = json.dumps(shown | {"last_updated_unix": state["last_updated_unix"], "last_invoked_unix": state["last_invoked_unix"], "diff_mode": a.diff})
    elif a.diff:
        text = render.meter(state, "Since last invocation", counters.difference(state))
    elif since is not None:
        shown = counters.since(state, since, int(time.time()))
        text = render.meter(state, "Since (within window)" if any(shown.values()) else "Since (no activity in window)", shown)
    else:
        text = render.meter(state, "Cumulative", {c: state[c] for c in meter_ops.COUNTERS})
    counters.write(folder, counters.snapshot(state))
    return text


def _counts(summary) -> str:
    return ", ".join(f"{n} {t}" for t, n in sorted(summary.rows.items())) + "; resolved " + ", ".join(f"{n} {t}" for t, n in sorted(summary.resolved.items()))


def _symbol(ix: Index, text: str, at: str | None = None) -> int:
    sid = ix.find(text, at)
    if sid is None:
        raise Refused(f"no symbol matches '{text}'")
    return sid


def _run(a, ix: Index) -> str:
    if a.verb == "init":
        ix.init(not a.no_gitignore)
        return f"ready: {ix.state}"
    if a.verb == "index":
        ix.init(False)
        s = ix.build()
        return f"indexed {s.rows['files']} files: {_counts(s)}"
    if not ix.store.exists():
        if a.verb == "add":
            got, how = ix.add(a.url)
            return f"{how}: {got.path}"
        raise Refused("there is no index here; build it first")
    if a.verb == "update":
        s = ix.update()
        return "nothing changed" if s.is_empty else f"{s.changed} changed, {s.new} new, {s.deleted} deleted: {_counts(s)}"
    if a.verb == "add":
        got, how = ix.add(a.url)
        return f"{how}: {got.path}"
    if a.verb == "watch":
        from symloom.streaming.tree import watch_tree

        watch_tree(ix, a.debounce, a.max_batches)
        return "watch ended"
    if a.verb == "serve":
        from symloom.server import Server

        Server(ix).serve(sys.stdin, sys.stdout)
        return ""
    try:
        ix.ensure_fresh()
    except Exception as e:  # an answer from the index as it is beats none
        print(f"symloom: the index couldn't be updated: {e}", file=sys.stderr)
    if a.verb == "query":
        return render.query(ix.query(a.question, a.dfs, a.budget))
    if a.verb == "map":
        return render.map_(ix.map(a.scope, a.depth))
    if a.verb == "path":
        return render.path(a.start, a.goal, ix.path(_symbol(ix, a.start), _symbol(ix, a.goal)))
    if a.verb == "slice":
        path, _, line = a.location.rpartition(":")
        found = ix.slice(path, int(line), a.budget)
        if found is None:
            raise Refused(f"nothing is indexed at {a.location}")
        return render.slice_(a.location, found)
    sid = _symbol(ix, a.symbol, getattr(a, "at", None))
    if a.verb == "follow":
        return render.follow(a.symbol, ix.follow(sid, a.budget))
    if a.verb == "refs":
        return render.refs(a.symbol, a.limit, ix.refs(sid, a.limit))
    return render.explain(ix.explain(sid))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
