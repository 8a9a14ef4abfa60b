"""An index of a small tree: built, updated, asked, served."""

from __future__ import annotations

import contextlib
import io
import json
import os
import shutil

import pytest

from symloom import cli, render
from symloom.index import Index
from symloom.operators import load
from symloom.operators.lookup import Ambiguous
from symloom.server import Server

TREE = {
    "src/main.rs": "fn main_entry() {}\n",
    "src/lib.rs": "pub fn lib_root() -> u8 { 1 }\n",
    "src/foo/mod.rs": "pub fn foo_mod() {}\n",
    "src/foo/bar.rs": "/// Says bar.\npub fn bar_fn() { helper(); helper(); }\nfn helper() {\n    let a = 1;\n    let b = 2;\n}\n",
    "pkg/__init__.py": "def pkg_init(): pass\n",
    "pkg/sub.py": "import os\n\n\ndef sub_fn():\n    return pkg.pkg_init()\n\n\ndef helper():\n    pass\n",
    "a.rs": "use b::middle;\npub fn entry() {}\n",
    "b.rs": "use c::leaf;\npub fn middle() {}\n",
    "c.rs": "pub fn leaf() {}\n",
    "ignored/x.rs": "fn x() {}\n",
    ".hidden/y.rs": "fn y() {}\n",
    "notes.txt": "none",
    "noext": "none",
    ".gitignore": "ignored/\n",
}


def planted(at):
    for path, text in TREE.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    return at


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """One index for all tests, which copy its folder if they change something."""
    root = planted(tmp_path_factory.mktemp("tree"))
    out = Index(spark, str(root))
    out.init()
    out.build()
    return root


@pytest.fixture
def root(built, tmp_path):
    shutil.copytree(built, tmp_path / "tree", copy_function=shutil.copy2)
    return tmp_path / "tree"


@pytest.fixture
def ix(spark, root):
    return Index(spark, str(root))


def names(ix):
    return {r.qualified_name for r in ix.store.read("symbols").collect()}


def test_build_and_ask(ix, root, spark):
    files = {r.path for r in ix.store.read("files").collect()}
    assert files == {p for p in TREE if p.endswith((".rs", ".py")) and not p.startswith(("ignored", "."))}
    assert {"src::lib_root", "src::main_entry", "src::foo::foo_mod", "src::foo::bar::bar_fn", "pkg.pkg_init", "pkg.sub.sub_fn"} <= names(ix)
    ids = [r.id for r in ix._named.orderBy("path", "start_line").collect()]
    assert ids == list(range(1, len(ids) + 1))
    # two calls of the same file's helper and one by qualified name
    assert ix.store.read("calls").where("callee_symbol_id IS NOT NULL").count() == 3
    assert ix.store.read("imports").where("resolved_symbol_id IS NOT NULL").count() == 2

    sid = ix.find("src::foo::bar::helper")
    followed = ix.follow(sid, 2000)
    assert followed["body"][0] == "fn helper() {" and len(followed["body"]) == 4 and not followed["truncated"]
    assert [c.name for c in followed["callers"]] == ["bar_fn"]
    tight = ix.follow(sid, 8)
    assert tight["truncated"] and tight["body"] == ["fn helper() {"]
    assert ix.follow(10_000) is None
    refs = ix.refs(sid)
    assert len(refs["sites"]) == 2 and not refs["truncated"] and ix.refs(sid, 1)["truncated"]
    with pytest.raises(Ambiguous, match="across languages"):
        ix.find("helper")
    assert ix.find("helper", "pkg/sub.py:1") == ix.find("pkg.sub.helper") and ix.find("nothing_here") is None and ix.find(" ") is None

    hops = ix.path(ix.find("entry"), ix.find("leaf"))
    assert [n.name for n, _ in hops] == ["entry", "middle", "leaf"] and [k for _, k in hops] == [None, "import", "import"]
    assert ix.path(ix.find("entry"), ix.find("main_entry")) is None and len(ix.path(sid, sid)) == 1
    assert ix.slice("src/foo/bar.rs", 4)["focus"].name == "helper" and ix.slice("src/foo/bar.rs", 99) is None and ix.slice("gone.rs", 1) is None
    assert ix.slice("pkg/sub.py", 4)["imports"] == ["os"]
    tree = ix.map()["root"]
    assert tree["files"] == 9 and [c["path"] for c in tree["children"]] == ["pkg", "src"] and tree["children"][1]["children"][0]["path"] == "src/foo"
    assert ix.map("src", 0)["root"]["children"] == [] and ix.map("nowhere")["root"]["files"] == 0
    assert {n.name for n in ix.query("where is bar_fn")["nodes"]} == {"bar_fn", "helper"}
    assert ix.query("what does the")["seeds"] == 0
    assert [n.name for n in ix.explain(sid)["callees"]] == ["bar_fn"]
    # all texts that are shown
    assert "Says bar." in render.follow("x", ix.follow(ix.find("bar_fn"))) and "**Callers** (1 shown)" in render.follow("x", followed)
    assert "2 reference sites**" in render.refs("x", 20, refs) and "showing first 1, more exist past --limit 1" in render.refs("x", 1, ix.refs(sid, 1))
    assert "**Distance:** 2 edges" in render.path("a", "b", hops) and "_No path found" in render.path("a", "b", None)
    assert "└── src/  (4 files, 5 symbols)" in render.map_(ix.map())
    assert "## Callees (1)" in render.explain(ix.explain(sid)) and "_No symbols matched" in render.query(ix.query("zzz qqq"))
    assert "**Imports** (1 shown)" in render.slice_("pkg/sub.py:4", ix.slice("pkg/sub.py", 4))


def same_index(a: Index, b: Index) -> None:
    for table, keys in (("symbols", "qualified_name, kind, start_line"), ("calls", "callee_raw_name, line, callee_symbol_id IS NULL"), ("imports", "raw_path, resolved_symbol_id IS NULL"), ("refs", "raw_name, line, symbol_id IS NULL")):
        rows = [sorted(map(tuple, x.store.read(table).selectExpr(*keys.split(", ")).collect())) for x in (a, b)]
        assert rows[0] == rows[1], table


def test_update_equals_rebuild(ix, root, spark):
    assert ix.update().is_empty
    before = ix.store.read("symbols").count()
    (root / "c.rs").write_text("pub fn leaf() {}\npub fn extra() {}\n")
    (root / "d.rs").write_text("pub fn fresh() { extra(); }\n")
    os.remove(root / "src/main.rs")
    s = ix.update()
    assert (s.changed, s.new, s.deleted) == (1, 1, 1) and ix.store.read("symbols").count() == before + 1
    assert ix.store.read("imports").where("resolved_symbol_id IS NOT NULL").count() == 2  # the import of the changed file is found again
    other = Index(spark, str(root))
    updated = Index(spark, str(root))
    updated.store = type(ix.store)(spark, str(root / "other"))
    updated.store.open()
    updated.build()
    same_index(other, updated)
    assert ix.update().is_empty


def test_freshness(ix, root, monkeypatch):
    assert ix.ensure_fresh(False)[0] == "disabled"
    assert ix.ensure_fresh(throttle=0)[0] == "up-to-date"
    assert ix.ensure_fresh()[0] == "throttled"
    (root / "e.rs").write_text("fn e() {}\n")
    assert ix.ensure_fresh(throttle=0)[0] == "updated" and "e::e" in names(ix)
    monkeypatch.setenv("SYMLOOM_FRESHNESS", "off")
    assert ix.ensure_fresh()[0] == "disabled"


def test_add(ix, root, tmp_path_factory):
    far = tmp_path_factory.mktemp("far")
    (far / "module.py").write_text("def fetched(): pass\n")
    (far / "notes.txt").write_text("text")
    got, how = ix.add(f"file://{far}/module.py")
    assert how == "indexed" and ix.find("fetched") and got.path.endswith(f"raw/local/{got.sha8}.py")
    assert open(got.path.rpartition(".")[0] + ".meta").read().startswith("url=file://")
    assert ix.add(f"file://{far}/module.py")[1] == "present" and ix.add(f"file://{far}/notes.txt")[1] == "saved"
    with pytest.raises(ValueError):
        ix.add("not an address")
    assert ix.update().is_empty and ix.find("fetched")  # what was added isn't taken for deleted


def test_init_is_idempotent(spark, tmp_path):
    for text in ("", "x\n", "/.symloom\n"):
        (tmp_path / ".gitignore").write_text(text)
        Index(spark, str(tmp_path)).init()
        assert sum(".symloom" in x for x in (tmp_path / ".gitignore").read_text().splitlines()) == 1
    ix = Index(spark, str(tmp_path))
    assert ix.store.open() == ix.store.version() == 2 and ix.query("anything here")["seeds"] == 0
    assert {r.n_rows for r in load.counts(ix.store.tables()).collect()} == {0}


@pytest.mark.parametrize("step", ["rename", "remove"])
def test_a_job_that_dies_leaves_an_index(ix, root, spark, monkeypatch, step):
    """Between the new snapshot and its pointer the old index counts; after it the new one, whatever wasn't tidied."""
    before = names(ix)
    (root / "c.rs").write_text("pub fn leaf() {}\npub fn extra() {}\n")
    ix.upsert_paths(["b.rs"])

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr("symloom.shared." + step, dies)
        m.setattr("symloom.index.scratch", contextlib.nullcontext)
        with pytest.raises(OSError):
            ix.update()
    again = Index(spark, str(root))
    assert again.store.open() == 2 and names(again) == before | ({"c::extra"} if step == "remove" else set())
    again.update()
    assert names(again) == before | {"c::extra"}


def test_a_tree_by_its_address(spark, tmp_path):
    """A root with a scheme is read and kept through its file system."""
    root = planted(tmp_path)
    ix = Index(spark, f"file://{root}")
    ix.root, ix.state = f"file://{root}", f"file://{root}/.symloom"  # as one that isn't of this machine
    ix.store = type(ix.store)(spark, f"{ix.state}/index")
    ix.init()
    ix.build()
    assert ix.find("leaf") and ".symloom/" in (root / ".gitignore").read_text() and ix.follow(ix.find("leaf"))["body"] == ["pub fn leaf() {}"]
    (root / "c.rs").write_text("pub fn leaf() {}\npub fn extra() {}\n")
    assert ix.ensure_fresh()[0] == "updated" and ix.find("extra") and ix.ensure_fresh(throttle=600)[0] == "throttled"
    assert ix.update_paths(["c.rs", "ignored/x.rs", "none.rs"]).is_empty
    with pytest.raises(ValueError):
        ix.add("file:///x.py")


def test_migration(ix, spark):
    tables = ix.store.tables()
    tables["symbols"] = tables["symbols"].drop("doc_comment")
    ix.store.publish({n: df for n, df in tables.items()}, schema_version=1)
    assert ix.store.version() == 1 and ix.store.open() == 2
    assert "doc_comment" in ix.store.read("symbols").columns and ix.store.read("edges").count() > 0


def test_server(ix, spark, tmp_path):
    server = Server(ix)
    ask = lambda **m: server.handle(json.dumps(dict(jsonrpc="2.0", id=1) | m))
    tool = lambda name, **a: ask(method="tools/call", params={"name": name, "arguments": a})
    assert server.handle("{")["error"]["code"] == -32700 and ask()["error"]["code"] == -32600 and ask(method="no")["error"]["code"] == -32601
    assert len(ask(method="tools/list")["result"]["tools"]) == 7 and "serverInfo" in ask(method="initialize")["result"]
    assert server.handle('{"method": "tools/list"}') is None and ask(method="shutdown")["result"] is None
    assert tool("none")["error"]["code"] == -32602 and tool("follow")["error"]["code"] == -32602 and tool("follow", symbol="zzz")["error"]["code"] == -32602
    assert "# Follow: `src::foo::bar::bar_fn`" in tool("follow", symbol="bar_fn")["result"]["content"][0]["text"]
    for name, a in (("refs", {"symbol": "leaf"}), ("query", {"question": "leaf", "dfs": True}), ("explain", {"symbol": "leaf"}), ("path", {"from": "entry", "to": "leaf"}), ("slice", {"location": "a.rs:2"}), ("map", {})):
        assert tool(name, **a)["result"]["isError"] is False, name
    assert tool("slice", location="a.rs")["error"]["code"] == -32602
    assert Server(Index(spark, str(tmp_path / "pkg"))).handle(json.dumps(dict(params=dict(name="map"), method="tools/call", id=2)))["error"]["code"] == -32603
    out = io.StringIO()
    server.serve(io.StringIO('\n{"id": 1, "method": "ping"}\n{"method": "initialized"}\n'), out)
    assert json.loads(out.getvalue()) == dict(result={}, jsonrpc="2.0", id=1)


def test_command_line(spark, tmp_path, capsys):
    root = planted(tmp_path)
    run = lambda *a: cli.main(list(a), str(root), spark)
    assert run("query", "x") == 1 and run("no/such/folder") == 2 and run("slice", "nowhere") == 2 and run("meter", "--since", "5x") == 2 and run("query") == 2
    assert cli.main([str(root)], ".", spark) == 0 and cli.main([str(root), "--update"], ".", spark) == 0
    assert "nothing changed" in capsys.readouterr().out
    for words in (["query", "leaf"], ["query", "leaf", "--dfs", "--budget", "100"], ["follow", "leaf"], ["follow", "helper", "--from", "pkg/sub.py:8"], ["refs", "leaf"], ["slice", "a.rs:2"], ["path", "entry", "leaf"], ["explain", "leaf"], ["map", "--scope", "src", "--depth", "1"], ["update"], ["init"]):
        assert run(*words) == 0, words
    assert run("follow", "helper") == 1 and run("slice", "a.rs:99") == 1
    assert run("meter", "--record-input", "5", "--record-output", "7") == 0 and run("meter", "--json") == 0
    assert '"input_tokens": 5' in capsys.readouterr().out
    assert run("meter", "--diff") == 0 and "input_tokens:  0" in capsys.readouterr().out
    assert run("meter", "--since", "1h") == 0 and "within window" in capsys.readouterr().out and run("meter", "--reset") == 0
