"""The whole text of every kind of answer."""

from __future__ import annotations

from types import SimpleNamespace as Node

from symloom import render


def node(name: str, kind: str = "function", path: str = "src/a.rs", line: int = 3, **more) -> Node:
    return Node(qualified_name=name, kind=kind, path=path, start_line=line, **more)


RUN = node("app::run", language="rust", doc_comment="Runs it.\nTwice.", signature="pub fn run(n: u8)")


def test_query():
    answer = {"question": "who runs", "nodes": [RUN, node("app::b", path="src/b.rs", line=9), node("app::c", "struct", "src/b.rs", 2)], "seeds": 1, "edges": {"call": 2}, "n_edges": 2, "mode": "bfs", "budget": 2000, "used": 240}
    assert render.query(answer) == """# Query: who runs

## Seeds (1)
- `app::run` (function) — `src/a.rs:3`

## Expanded (2)
- `src/b.rs`
  - `app::c` (struct) — line 2
  - `app::b` (function) — line 9

## Edges traversed
- 0 parent / 2 call / 0 type / 0 import

_traversal: bfs, budget: 2000 tokens, est: 240 tokens, nodes: 3, edges: 2_
"""
    none = {"question": "x", "nodes": [], "seeds": 0, "edges": {}, "n_edges": 0, "mode": "dfs", "budget": 9, "used": 0}
    assert render.query(none).startswith("# Query: x\n\n_No symbols matched") and render.query(none).count("\n") == 3


def test_follow():
    answer = {"focus": RUN, "body": ["pub fn run(n: u8) {", "}"], "truncated": False, "callers": [node("app::main", line=1)]}
    assert render.follow("run", answer) == """# Follow: `app::run`

**Kind:** function • **Language:** rust • **File:** `src/a.rs:3` • **Resolved from:** `run`

**Doc**

> Runs it.
> Twice.

**Signature**

```rust
pub fn run(n: u8)
```

**Body** (2 lines)

```rust
pub fn run(n: u8) {
}
```

**Callers** (1 shown)
- `app::main` (function) — `src/a.rs:1`

"""
    bare = {"focus": node("x", path="a.dart", language="dart", doc_comment=None, signature=None), "body": [], "truncated": True, "callers": []}
    assert render.follow("x", bare).endswith("_Body omitted — budget too tight for any body lines._\n\n_No callers recorded in the index._\n\n")
    cut = {"focus": RUN, "body": ["a"], "truncated": True, "callers": []}
    assert "**Body** (1 lines, truncated to fit budget)\n\n```rust\na\n```\n" in render.follow("x", cut)


def test_refs():
    sites = [(node("app::main"), Node(kind="call", path="src/m.rs", line=7)), (None, Node(kind="type", path="src/n.rs", line=1))]
    assert render.refs("run", 20, {"focus": RUN, "sites": sites, "truncated": False}) == """# Refs: `app::run`

**Kind:** function • **Defined at:** `src/a.rs:3` • **Resolved from:** `run`

**2 reference sites**

- [call] `app::main` (function) → `src/m.rs:7`
- [type] _<module-level>_ → `src/n.rs:1`

"""
    assert "**1 reference site (showing first 1, more exist past --limit 1)**" in render.refs("run", 1, {"focus": RUN, "sites": sites[:1], "truncated": True})
    assert render.refs("run", 1, {"focus": RUN, "sites": [], "truncated": False}).endswith("\n\n_No references recorded in the index._\n\n")


def test_explain():
    none = {b: [] for b in ("parents", "children", "callers", "callees", "types", "imports")}
    assert render.explain({"focus": RUN} | none | {"parents": [node("app", "module", line=1)], "callees": [node("app::b"), node("app::c")]}) == """# Explain: `app::run`

**Kind:** function • **File:** `src/a.rs:3`

**Neighbors:** 3 total (1 parent / 0 child / 0 caller / 2 callee / 0 type / 0 import)

## Parents (1)
- `app` (module) — `src/a.rs:1`

## Callees (2)
- `app::b` (function) — `src/a.rs:3`
- `app::c` (function) — `src/a.rs:3`

"""
    assert "no parents, children, callers, callees, type relations, or imports" in render.explain({"focus": RUN} | none)


def test_path():
    assert render.path("a", "c", [(node("a"), None), (node("b", line=4), "call"), (node("c", line=5), "import")]) == """# Path: a → c

**Distance:** 2 edges

## Hops
1. `a` (function) — `src/a.rs:3`
   → via call
2. `b` (function) — `src/a.rs:4`
   → via import
3. `c` (function) — `src/a.rs:5`

"""
    assert render.path("a", "a", [(node("a"), None)]) == "# Path: a → a\n\n_Source and destination are the same symbol._\n- `a` (function) — `src/a.rs:3`\n"
    assert render.path("a", "b", None) == "# Path: a → b\n\n_No path found between the two symbols._\n"


def test_slice():
    answer = {"focus": RUN, "imports": ["std::fs", "b::c"], "body": ["x"], "truncated": False}
    assert render.slice_("src/a.rs:4", answer) == """# Slice: `src/a.rs:4`

**Encloses:** `app::run` (function) • **File:** `src/a.rs:3`

**Imports** (2 shown)

```rust
use std::fs;
use b::c;
```

**Signature**

```rust
pub fn run(n: u8)
```

**Body** (1 lines)

```rust
x
```

"""


def test_map():
    symbol = lambda name, n: {"qualified_name": name, "kind": "function", "path": "src/a.rs", "start_line": 3, "caller_count": n}
    leaf = lambda path, **more: {"path": path, "files": 1, "symbols": 2, "kinds": [], "top": [], "children": []} | more
    src = leaf("src", kinds=[("function", 2)], top=[symbol("app::run", 2), symbol("app::b", 1)], children=[leaf("src/x"), leaf("src/y", kinds=[(k, 1) for k in "abcdef"])])
    root = {"path": "", "files": 4, "symbols": 8, "kinds": [("function", 8)], "top": [], "children": [src, leaf("zed", kinds=[("struct", 1)])]}
    assert render.map_({"scope": "", "depth": 2, "root": root}) == """# Map: <project root>

**Files:** 4 • **Symbols:** 8 • **Depth:** 2

./  (4 files, 8 symbols)
kinds: function=8
├── src/  (1 files, 2 symbols)
│   kinds: function=2
│   top:
│     - app::run (function) — src/a.rs:3 [2 callers]
│     - app::b (function) — src/a.rs:3 [1 caller]
│   ├── x/  (1 files, 2 symbols)
│   └── y/  (1 files, 2 symbols)
│       kinds: a=1, b=1, c=1, d=1, e=1
└── zed/  (1 files, 2 symbols)
    kinds: struct=1
"""
    assert render.map_({"scope": "src", "depth": 0, "root": leaf("src")}) == "# Map: src\n\n**Files:** 1 • **Symbols:** 2 • **Depth:** 0\n\nsrc/  (1 files, 2 symbols)\n"


def test_meter():
    text = render.meter({"last_updated_unix": 99}, "Cumulative", {"input_tokens": 5, "output_tokens": 7, "calls": 2})
    assert text == """# Meter

**Cumulative**

- input_tokens:  5
- output_tokens: 7
- calls:         2
- last_updated:  unix 99
"""
