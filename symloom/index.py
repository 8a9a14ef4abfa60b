"""An index of a source tree: built, kept up with the tree, and asked."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from symloom import shared
from symloom.extract.pipeline import extract
from symloom.operators import diff, graph, load, lookup, resolve, traverse, tree, verbs
from symloom.shared import scratch, stored
from symloom.sources import discover, fetch
from symloom.sources.registry import EXTENSIONS
from symloom.sources.store import Store

STATE = ".symloom"
ADDED = f"{STATE}/raw/"
CONFIG = "# settings of the index of this tree\n"
THROTTLE_SECONDS = 5
_NODE = ["id", "qualified_name", "name", "kind", "path", "start_line", "language"]


@dataclass
class Summary:
    """Rows in the tables after a build or update, what was resolved, and which files it was about."""

    rows: dict[str, int] = field(default_factory=dict)
    resolved: dict[str, int] = field(default_factory=dict)
    changed: int = 0
    new: int = 0
    deleted: int = 0

    @property
    def is_empty(self) -> bool:
        return not (self.changed or self.new or self.deleted)


class Index:
    def __init__(self, spark: SparkSession, root: str) -> None:
        """root: a folder of this machine, or of any file system by its address; what belongs to the index lies below it."""
        local = discover.local_path(root)
        self.spark, self.root = spark, local if local is not None else root.rstrip("/")
        self.state = f"{self.root}/{STATE}"
        self.store = Store(spark, f"{self.state}/index")

    def _at(self, name: str) -> str:
        """The address of a file below the root."""
        return f"{self.root}/{name}" if "://" in self.root else f"file://{self.root}/{name}"

    # --- building and upkeep

    def init(self, ignore_entry: bool = True) -> None:
        """State folder, settings and an ignore entry; what is there already stays."""
        if not shared.exists(self.spark, self._at(f"{STATE}/config")):
            shared.write_text(self.spark, self._at(f"{STATE}/config"), CONFIG)
        self.store.open()
        if ignore_entry:
            at = self._at(discover.IGNORE_FILE)
            text = shared.read_text(self.spark, at) if shared.exists(self.spark, at) else ""
            if not {STATE, f"{STATE}/", f"/{STATE}", f"/{STATE}/"} & {x.strip() for x in text.splitlines()}:
                shared.write_text(self.spark, at, text + ("\n" if text and not text.endswith("\n") else "") + f"{STATE}/\n")

    def build(self, strict: bool = False) -> Summary:
        """Everything anew; files that were added by address stay."""
        with scratch(self.spark):
            files = self._listed()
            return self._publish(load.flatten(extract(discover.read(files, self.root)), strict=strict), Summary(new=files.count()))

    def _listed(self) -> DataFrame:
        found = discover.listed(self.spark, self.root)
        if shared.exists(self.spark, self._at(ADDED)):
            added = [p for p, _, _ in discover.files_below(self.root, ADDED.rstrip("/")) if p.rpartition(".")[2] in EXTENSIONS]
            if added:
                found = found.unionByName(discover.named(self.spark, added))
        return found

    def _publish(self, tables: dict[str, DataFrame], summary: Summary) -> Summary:
        """Resolves all rows from their raw names and makes the snapshot current."""
        s = stored(tables["symbols"], "symbols")
        clear = {"calls": ["callee_symbol_id"], "types": ["target_symbol_id"], "refs": ["symbol_id"], "imports": ["resolved_symbol_id", "resolved_file_id"]}
        out, look = {"files": tables["files"], "symbols": s}, resolve.names(s)
        for name, f in (("calls", resolve.calls), ("types", resolve.types), ("refs", resolve.refs), ("imports", resolve.imports)):
            out[name] = f(tables[name].drop(*clear[name]), look)
        self.store.publish(out)
        now = self.store.tables()
        summary.rows = {r.table_name: r.n_rows for r in load.counts(now).collect()}
        summary.resolved = {r.table_name: r.resolved for r in resolve.stats({n: now[n] for n in clear}).collect()}
        return summary

    def update(self, compat_cascade: bool = False) -> Summary:
        """Extracts what changed or is new, drops what is gone, and resolves again; nothing is written if nothing changed.

        All files are read once for their hashes; contents of unchanged ones go no further.
        """
        with scratch(self.spark):
            return self._update(compat_cascade)

    def update_paths(self, paths: list[str]) -> Summary:
        """As update(), for some paths that may have changed: nothing else is listed or read. A path that ends with a slash is all that was below it."""
        if any(p.rpartition("/")[2] == discover.IGNORE_FILE for p in paths):
            return self.update()  # other files may count now
        with scratch(self.spark):
            tables = self.store.tables()
            names = [p for p in paths if not p.endswith("/")]
            about = F.col("path").isin(names)
            for folder in (p for p in paths if p.endswith("/")):
                about = about | F.startswith("path", F.lit(folder))
            rules = discover.rules_above(self.root, names)
            listed = discover.named(self.spark, [p for p in names if not rules.ignored(p) and not any(x.startswith(".") for x in p.split("/"))])
            return self._changed(tables, tables["files"].where(about), listed, False)

    def _update(self, compat_cascade: bool) -> Summary:
        tables = self.store.tables()
        return self._changed(tables, tables["files"], self._listed(), compat_cascade)

    def _changed(self, tables: dict[str, DataFrame], known: DataFrame, listed: DataFrame, compat_cascade: bool) -> Summary:
        state = stored(diff.file_diff(known, discover.read(listed, self.root, content=False)), "diff")
        n = diff.summary(state).first()
        summary = Summary(changed=n.changed, new=n.new, deleted=n.deleted)
        if n.is_empty:
            return summary
        wanted = listed.join(state.where("state IN ('changed', 'new')").select("path"), "path", "left_semi")
        batch = load.flatten(extract(discover.read(wanted, self.root)), diff.next_ids(tables))
        return self._publish(diff.upsert(tables, batch, state.where("state = 'deleted'").select("path"), compat_cascade), summary)

    def upsert_paths(self, paths: list[str]) -> Summary:
        """Extracts some files, whatever their state, and replaces their rows."""
        with scratch(self.spark):
            tables = self.store.tables()
            files = discover.read_files(self.spark, self.root, paths)
            batch = load.flatten(extract(files), diff.next_ids(tables))
            return self._publish(diff.upsert(tables, batch, files.select("path").limit(0)), Summary(new=len(paths)))

    def ensure_fresh(self, enabled: bool = True, throttle: float = THROTTLE_SECONDS) -> tuple[str, Summary | None]:
        """disabled, throttled, up-to-date or updated. The stamp is set before the work, so askers at once don't all do it."""
        if not enabled or os.environ.get("SYMLOOM_FRESHNESS", "").lower() in ("0", "off", "false", "no"):
            return "disabled", None
        throttle = float(os.environ.get("SYMLOOM_FRESHNESS_SECONDS", throttle))
        stamp = self._at(f"{STATE}/fresh")
        last = shared.modified(self.spark, stamp)
        if last is not None and time.time() - last < throttle:
            return "throttled", None
        shared.write_text(self.spark, stamp, str(int(time.time())))
        summary = self.update()
        return ("up-to-date", None) if summary.is_empty else ("updated", summary)

    def add(self, url: str) -> tuple[fetch.Fetched, str]:
        """Fetches an address and indexes it if its language is known: indexed, saved or present. Only a tree of this machine takes files."""
        if "://" in self.root:
            raise ValueError(f"{self.root} is no folder of this machine")
        got = fetch.fetch(url, self.state)
        ext = got.path.rpartition(".")[2].lower()
        if got.already_present:
            return got, "present"
        if ext not in EXTENSIONS or not self.store.exists():
            return got, "saved"
        self.upsert_paths([os.path.relpath(got.path, self.root).replace(os.sep, "/")])
        return got, "indexed"

    # --- asking

    @property
    def _named(self) -> DataFrame:
        return graph.decorated(self.store.read("symbols"), self.store.read("files"))

    def nodes(self, ids: list[int]) -> dict[int, Row]:
        if not ids:
            return {}
        return {r.id: r for r in self._named.where(F.col("id").isin(list(set(ids)))).select(*_NODE).collect()}

    def find(self, text: str, at: str | None = None) -> int | None:
        """The symbol that a text means; at (FILE:LINE) keeps the candidates of one file."""
        path = at.rpartition(":")[0] if at and at.rpartition(":")[2].isdigit() else None
        return lookup.find(self.store.read("symbols"), self.store.read("files"), text, path or None)

    def query(self, question: str, depth_first: bool = False, budget: int = 2000) -> dict:
        seeds = [r.id for r in lookup.seeds(self.store.read("symbols"), question).orderBy("position").collect()]
        if not seeds:
            return {"question": question, "nodes": [], "seeds": 0, "edges": {}, "n_edges": 0, "mode": "dfs" if depth_first else "bfs", "budget": budget, "used": 0}
        walk = (traverse.depth_first if depth_first else traverse.breadth_first)(self.store.read("edges"), seeds, budget)
        known = self.nodes(walk.nodes)
        kinds = {r.kind: r.edges for r in graph.breakdown(walk.edges).collect()}
        return {"question": question, "nodes": [known[n] for n in walk.nodes if n in known], "seeds": walk.seeds, "edges": kinds, "n_edges": sum(kinds.values()), "mode": "dfs" if depth_first else "bfs", "budget": budget, "used": walk.used}

    def _body(self, row: Row, budget: int) -> tuple[list[str], bool]:
        """The lines of a symbol's text that fit; read from the tree, none if the file is gone or shorter."""
        content = discover.read_files(self.spark, self.root, [row.path]).select("content")
        spec = content.select("content", F.lit(row.body_start_byte).alias("a"), F.lit(row.body_end_byte).alias("b"), F.lit(row.signature).cast("string").alias("signature"))
        got = verbs.within_budget(verbs.body(spec, "a", "b"), "body", "signature", budget).select("kept", "truncated").first()
        return (list(got.kept), got.truncated) if got else ([], False)

    def follow(self, sid: int, budget: int = 2000) -> dict | None:
        row = self._named.where(F.col("id") == sid).first()
        if row is None:
            return None
        body, cut = self._body(row, budget)
        top = verbs.first_callers(self.store.read("calls").where(F.col("callee_symbol_id") == sid)).orderBy("rank").collect()
        known = self.nodes([r.caller_symbol_id for r in top])
        return {"focus": row, "body": body, "truncated": cut, "callers": [known[r.caller_symbol_id] for r in top if r.caller_symbol_id in known]}

    def refs(self, sid: int, limit: int = 20, dedup_calls: bool = False) -> dict | None:
        focus = self.nodes([sid]).get(sid)
        if focus is None:
            return None
        calls, refs = self.store.read("calls").where(F.col("callee_symbol_id") == sid), self.store.read("refs").where(F.col("symbol_id") == sid)
        files = refs.select("file_id").distinct()
        near = self.store.read("symbols").join(files.unionAll(calls.select("file_id").distinct()).distinct(), "file_id", "left_semi").unionByName(self.store.read("symbols").join(calls.select(F.col("caller_symbol_id").alias("id")).distinct(), "id", "left_semi").select(*self.store.read("symbols").columns)).dropDuplicates(["id"])
        rows = verbs.sites(calls, refs, near, self.store.read("files"), limit, dedup_calls).orderBy("position").collect()
        known = self.nodes([r.caller_id for r in rows if r.caller_id is not None])
        return {"focus": focus, "sites": [(known.get(r.caller_id), r) for r in rows], "truncated": bool(rows) and rows[0].truncated}

    def explain(self, sid: int) -> dict | None:
        focus = self.nodes([sid]).get(sid)
        if focus is None:
            return None
        rows = verbs.neighbourhood(self.store.read("edges").where(F.col("src") == sid), self.store.read("symbols")).orderBy("bucket", "position").collect()
        known = self.nodes([r.neighbor_id for r in rows])
        out: dict = {"focus": focus} | {b: [] for b in ("parents", "children", "callers", "callees", "types", "imports")}
        for r in rows:
            out[r.bucket].append(known[r.neighbor_id])
        return out

    def path(self, start: int, goal: int) -> list[tuple[Row, str | None]] | None:
        found = traverse.shortest_path(self.store.read("edges"), self.store.read("symbols"), start, goal)
        if found is None:
            return None
        known = self.nodes([n for n, _ in found])
        return [(known[n], k) for n, k in found]

    def slice(self, path: str, line: int, budget: int = 2000) -> dict | None:
        asked = self.spark.createDataFrame([(0, path, line)], "site_id bigint, path string, line int")
        own = self.store.read("files").where(F.col("path") == path)
        symbols = self.store.read("symbols").join(F.broadcast(own.select("file_id")), "file_id", "left_semi")  # one row, paths are unique
        hit = verbs.slices(asked, symbols, own).first()
        if hit is None:
            return None
        row = self._named.where(F.col("id") == hit.enclosing_id).first()
        body, cut = self._body(row, budget)
        imports = verbs.file_imports(self.store.read("imports").where(F.col("file_id") == hit.file_id)).orderBy("rank").collect()
        return {"focus": row, "body": body, "truncated": cut, "imports": [r.raw_path for r in imports]}

    def map(self, scope: str | None = None, depth: int = 2) -> dict:
        return {"scope": tree.normal_scope(scope), "depth": depth, "root": tree.build(self.store.read("files"), self.store.read("symbols"), self.store.read("calls"), scope, depth)}
