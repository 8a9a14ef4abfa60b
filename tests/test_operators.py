"""Operators on small tables, and walks against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from symloom.functions import paths, text
from symloom.operators import diff, graph, load, lookup, meter, resolve, traverse, tree, verbs
from symloom.operators.ids import dense_ids
from symloom.sources import counters
from symloom.sources.ignore import Ignore

S = "id bigint, file_id bigint, qualified_name string, name string, kind string, start_line int, end_line int, parent_symbol_id bigint"


def symbols(spark, *rows):
    """(id, file, qualified name[, parent, start, end])"""
    full = []
    for r in rows:
        i, f, q, parent, a, b = (*r, *(None, 1, 10)[len(r) - 3 :])
        full.append((i, f, q, q.replace(".", "::").split("::")[-1], "function", a, b, parent))
    return spark.createDataFrame(full, S)


def files(spark, *paths_):
    return spark.createDataFrame([(i + 1, p, "rust") for i, p in enumerate(paths_)], "file_id bigint, path string, language string")


def calls(spark, *rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "id bigint, caller_symbol_id bigint, callee_raw_name string, file_id bigint, line int, col int")


def test_find_in_a_file_among_very_many(spark):
    s = spark.range(1, 10_051).selectExpr("id", "if(id > 10040, 2L, 1L) AS file_id", "concat('m', id, '::new') AS qualified_name", "'new' AS name", "'function' AS kind", "1 AS start_line", "2 AS end_line", "CAST(NULL AS bigint) AS parent_symbol_id")
    f = files(spark, "a.rs", "b.rs", "c.rs")
    one = s.where("id <= 10041")
    assert lookup.find(one, f, "new", "b.rs") == 10041 and lookup.find(one, f, "new", "c.rs") is None
    with pytest.raises(lookup.Ambiguous) as e:
        lookup.find(s, f, "new", "b.rs")
    assert [c.id for c in e.value.candidates] == list(range(10041, 10051))


def test_resolution(spark):
    s = symbols(spark, (1, 1, "a::f"), (2, 1, "b::g"), (3, 2, "x"), (4, 2, "a::f"), (5, 3, "m::x"), (6, 3, "n::x"))
    c = calls(spark, (1, "a::f", 2, 1, 0), (1, "g", 1, 2, 0), (1, "g", 2, 3, 0), (1, "x", 3, 4, 0), (1, "ghost", 1, 5, 0))
    got = {r.id: r.callee_symbol_id for r in resolve.calls(c, s).collect()}
    # a qualified name is found anywhere, the lowest id wins, and it comes before a name of the same file
    assert got == {1: 1, 2: 2, 3: None, 4: 3, 5: None}
    first = resolve.calls(c, s)
    assert {r.id: r.callee_symbol_id for r in resolve.calls(first, s).collect()} == got
    i = spark.createDataFrame([(1, 9, "a::f"), (2, 9, "none")], "id bigint, file_id bigint, raw_path string")
    assert [tuple(r) for r in resolve.imports(i, s).orderBy("id").select("resolved_symbol_id", "resolved_file_id").collect()] == [(1, 1), (None, None)]


def test_enclosing(spark):
    rng = random.Random(1)
    spans = [(i, rng.randint(1, 3), f"s{i}", None, a := rng.randint(1, 300), a + rng.choice([0, 0, 1, 5, 40, 900])) for i in range(1, 200)]
    sites = [(i, rng.randint(1, 4), rng.randint(0, 400)) for i in range(300)]
    got = {r.site_id: r.enclosing_id for r in graph.enclosing(spark.createDataFrame(sites, "site_id bigint, file_id bigint, line int"), symbols(spark, *spans)).collect()}
    for i, f, line in sites:
        inside = [(b - a, sid) for sid, file, _, _, a, b in spans if file == f and a <= line <= b]
        assert got[i] == (min(inside)[1] if inside else None)
    assert graph.enclosing(spark.createDataFrame(sites, "site_id bigint, file_id bigint, line int"), symbols(spark, *spans).limit(0)).where("enclosing_id IS NOT NULL").isEmpty()


EDGES = "src bigint, dst bigint, kind string, kind_rank int, row_id bigint, top_id bigint"


def random_graph(seed: int, n: int = 40, m: int = 90):
    rng = random.Random(seed)
    rows, near = [], defaultdict(list)
    for row in range(m):
        a, b, k = rng.randint(1, n), rng.randint(1, n), rng.randint(0, 3)
        if a != b:
            rows.append((k, row, a, b))
    for k, row, a, b in sorted(rows):
        near[a].append((b, graph.KINDS[k]))
        near[b].append((a, graph.KINDS[k]))
    return [(x, y, graph.KINDS[k], k, row, 0) for k, row, a, b in rows for x, y in ((a, b), (b, a))], near


def walked(near, seeds, budget, deep):
    nodes, met, used = list(seeds), set(), 80 * len(seeds)
    todo = deque(seeds)
    while todo and used + 80 <= budget:
        at = todo.pop() if deep else todo.popleft()
        for other, kind in near[at]:
            met.add((min(at, other), max(at, other), kind))
            if other not in nodes:
                if used + 80 > budget:
                    break
                nodes.append(other)
                used += 80
                todo.append(other)
    return nodes, met, used


@pytest.mark.parametrize("seed,budget", [(1, 0), (2, 400), (3, 999), (4, 2000), (5, 10_000)])
def test_walks(spark, seed, budget):
    rows, near = random_graph(seed)
    e = spark.createDataFrame(rows, EDGES)
    for deep, walk in ((False, traverse.breadth_first), (True, traverse.depth_first)):
        if deep and budget > 5000:
            continue
        got = walk(e, [3, 7, 11], budget)
        nodes, met, used = walked(near, [3, 7, 11], budget, deep)
        assert got.nodes == nodes and got.used == used
        assert {tuple(r) for r in got.edges.collect()} == met


def test_shortest_path(spark):
    rows, near = random_graph(9, 30, 34)
    e, s = spark.createDataFrame(rows, EDGES), symbols(spark, *[(i, 1, f"s{i}") for i in range(1, 31)])

    def plain(a, b):
        before, todo = {a: (None, None)}, deque([a])
        while todo:
            x = todo.popleft()
            for y, kind in near[x]:
                if y not in before:
                    before[y] = (x, kind)
                    todo.append(y)
        if b not in before:
            return None
        out = []
        while b is not None:
            out.append((b, before[b][1]))
            b = before[b][0]
        return out[::-1]

    assert traverse.shortest_path(e, s, 1, 2, on_driver=0) == plain(1, 2)  # over tables
    for a, b in ((1, 2), (3, 17), (5, 29), (8, 8), (12, 30)):
        assert traverse.shortest_path(e, s, a, b) == plain(a, b)
        back = traverse.shortest_path(e, s, b, a)
        assert (back is None) == (plain(a, b) is None) and (back is None or len(back) == len(plain(a, b)))
    assert traverse.shortest_path(e, s, 1, 99) is None
    far = {r.node: r.distance for r in traverse.distances(e, 1, 4).collect()}
    assert all(len(plain(1, n)) - 1 == d for n, d in far.items()) and set(far) == {n for n in range(1, 31) if plain(1, n) and len(plain(1, n)) <= 5}


def test_star_and_seeds(spark):
    s = symbols(spark, (1, 1, "center"), *[(i + 2, i + 2, f"leaf{i}") for i in range(10)])
    c = resolve.calls(calls(spark, *[(1, f"leaf{i}", 1, i, 0) for i in range(10)], (1, "center", 1, 20, 0), (1, "ghost", 1, 21, 0)), s)
    none = spark.createDataFrame([], "id bigint, symbol_id bigint, target_symbol_id bigint")
    no_imports = spark.createDataFrame([], "id bigint, file_id bigint, resolved_symbol_id bigint")
    e = graph.edges(s, c, none, no_imports)
    assert e.count() == 20  # a call of itself and one of nothing make no edge
    assert traverse.breadth_first(e, [1], 200).nodes == [1, 2]
    common = symbols(spark, *[(i, 1, f"common_{i}") for i in range(1, 22)])
    assert [r.id for r in lookup.seeds(common, "what about common things").orderBy("position").collect()] == [*range(1, 10), *range(10, 17)]
    assert lookup.seeds(common, "what does the").count() == 0


def test_questions(spark):
    ask = lambda q: spark.createDataFrame([(q,)], "q string").select(text.tokens(F.col("q")).alias("t")).first().t
    assert ask("How does foo::Bar.baz() use, the é1x ÄB ab :abc. abc?") == ["foo::bar.baz", "é1x", "Äb", "abc"]
    assert ask("") == [] and ask("a b c") == []


def test_names_that_texts_mean(spark):
    s = symbols(spark, (1, 1, "a::run"), (2, 2, "b::run"), (3, 3, "run_all"), (4, 4, "x.go"), (5, 5, "a::run::inner"), (6, 5, "go"))
    q = spark.createDataFrame([(x,) for x in ("a::run", "run", "inner", "::run", "go", "un_", "nope", "  ", "Run")], "q string")
    got = defaultdict(list)
    for r in lookup.candidates(s, q).collect():
        got[r.q].append((r.tier, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {"a::run": [(0, 1)], "run": [(1, 1), (1, 2)], "inner": [(1, 5)], "::run": [(3, 1), (3, 2), (3, 5)], "go": [(0, 6)], "un_": [(3, 3)]}


def test_lines_and_budgets(spark):
    def kept(body, signature, budget):
        df = spark.createDataFrame([(body, signature)], "body string, signature string")
        r = verbs.within_budget(df, "body", "signature", budget).first()
        return list(r.kept), r.truncated

    assert kept("a\r\nb\n\nc\r", None, 100) == (["a", "b", "", "c\r"], False) and kept("", None, 5) == ([], False) and kept("\n", None, 5) == ([""], False)
    assert kept("aa\nbb\ncc", None, 1) == (["aa"], True) and kept("aa\nbb", "12345", 2) == ([], True) and kept("é\n", None, 0) == ([], True)
    assert kept("abcdefghij\nb", "s", 2) == ([], True)  # the first line that doesn't fit ends it
    data = "aébc"
    df = spark.createDataFrame([(data.encode(), a, b) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (0, 5), (3, 99), (3, 3), (-1, 2), (3, 5))], "c binary, a int, b int")
    assert [r[0] for r in df.select(text.byte_slice(F.col("c"), F.col("a"), F.col("b"))).collect()] == ["a", "", "é", "", "aébc", "", "", "", "bc"]


def test_uses(spark):
    s = symbols(spark, (1, 1, "t"), (2, 1, "u", None, 20, 30), (3, 2, "v", None, 1, 5))
    c = resolve.calls(calls(spark, (3, "t", 2, 2, 0), (2, "t", 1, 25, 1), (2, "t", 1, 21, 2)), s)
    r = spark.createDataFrame([(1, 1, 1, 22, 0, "type"), (2, 1, 2, 99, 0, "call"), (3, None, 1, 1, 0, "type")], "id bigint, symbol_id bigint, file_id bigint, line int, col int, kind string")
    got = [(x.caller_id, x.kind, x.line, x.truncated) for x in verbs.sites(c, r, s, files(spark, "a.rs", "b.rs")).where("target_id = 1").orderBy("position").collect()]
    assert got == [(2, "call", 21, False), (2, "type", 22, False), (2, "call", 25, False), (3, "call", 2, False), (None, "call", 99, False)]
    assert [x.line for x in verbs.sites(c, r, s, files(spark, "a.rs", "b.rs"), 2).where("target_id = 1 AND truncated").orderBy("position").collect()] == [21, 25]
    assert verbs.sites(c, r, s, files(spark, "a.rs", "b.rs"), dedup_calls=True).where("target_id = 1").count() == 4
    assert [(x.id, x.caller_count) for x in verbs.caller_counts(s, c).orderBy("id").collect()] == [(1, 3), (2, 0), (3, 0)]
    assert [x.caller_symbol_id for x in verbs.first_callers(c).orderBy("rank").collect()] == [2, 3]


def test_neighbours(spark):
    s = symbols(spark, (1, 1, "Owner"), (2, 1, "Owner::method", 1), (3, 1, "Ownership"))
    none = spark.createDataFrame([], "id bigint, symbol_id bigint, target_symbol_id bigint")
    no_imports = spark.createDataFrame([], "id bigint, file_id bigint, resolved_symbol_id bigint")
    c = resolve.calls(calls(spark, (2, "Ownership", 1, 1, 0), (2, "Ownership", 1, 2, 0)), s)
    e = graph.edges(s, c, none, no_imports)
    got = {(r.id, r.bucket, r.neighbor_id) for r in verbs.neighbourhood(e, s).collect()}
    assert got == {(1, "children", 2), (2, "parents", 1), (2, "callees", 3), (3, "callees", 2)}
    assert {(r.id, r.bucket, r.neighbor_id) for r in verbs.directed_calls(c).collect()} == {(2, "callees", 3), (3, "callers", 2)}


def test_tree(spark):
    f = files(spark, "src/lang/rust.rs", "src/lang/python.rs", "src/walk.rs", "top.rs", "tests/x.rs")
    s = symbols(spark, (1, 1, "hot"), (2, 1, "cold"), (3, 2, "b"), (4, 3, "c"), (5, 4, "d"))
    c = resolve.calls(calls(spark, *[(2, "hot", 1, i, 0) for i in range(3)]), s)
    flat = lambda depth, scope=None: {r.dir: (r.file_count, r.symbol_count) for r in tree.rollup(f, s, scope, depth).collect()}
    assert flat(0) == {"": (5, 5)} and flat(1) == {"": (5, 5), "src": (3, 4), "tests": (1, 0)}
    assert flat(2) == {"": (5, 5), "src": (3, 4), "src/lang": (2, 3), "tests": (1, 0)}
    assert flat(1, "/src/") == {"src": (3, 4), "src/lang": (2, 3)} and flat(3, "src/walk.rs") == {"src/walk.rs": (1, 1)} and flat(2, "sr") == {}
    root = tree.build(f, s, c, None, 2)
    src = next(x for x in root["children"] if x["path"] == "src")
    assert [x["path"] for x in root["children"]] == ["src", "tests"] and src["children"][0]["top"][0]["qualified_name"] == "hot" and src["children"][0]["top"][0]["caller_count"] == 3
    assert [t["qualified_name"] for t in src["top"]] == ["c"] and src["kinds"] == [("function", 4)]
    assert tree.build(f, s, c, "none")["files"] == 0


def test_diff(spark):
    good, other = b"x" * 32, b"y" * 32
    old = spark.createDataFrame([("same", good), ("changed", good), ("gone", good), ("damaged", b"xx")], "path string, content_hash binary")
    now = spark.createDataFrame([("same", good), ("changed", other), ("new", good), ("damaged", b"xx")], "path string, content_hash binary")
    d = diff.file_diff(old, now)
    assert {r.path: r.state for r in d.collect()} == {"same": "unchanged", "changed": "changed", "gone": "deleted", "new": "new", "damaged": "new"}
    assert diff.summary(d).first().asDict() == {"unchanged": 1, "changed": 1, "new": 2, "deleted": 1, "to_extract": 3, "is_empty": False}
    assert diff.summary(diff.file_diff(old, old.where("path <> 'damaged'")).where("state <> 'deleted'")).first().is_empty


def record(path, syms, calls_=(), types_=()):
    s = [{"qualified_name": q, "name": q.split("::")[-1], "kind": "function", "start_line": 1, "start_col": 0, "end_line": 2, "end_col": 0, "body_start_byte": 0, "body_end_byte": 1, "signature": None, "visibility": None, "parent_qualified_name": p, "doc_comment": None} for q, p in syms]
    return (path, "rust", b"h" * 32, 1, 1, s, [], [{"caller_qualified_name": a, "callee_raw_name": b, "line": 1, "col": 0} for a, b in calls_], [{"raw_path": "u", "alias": None, "line": 1}], [{"owner_qualified_name": a, "relation": "r", "target_raw_name": b, "line": 1} for a, b in types_])


def test_loading(spark):
    from symloom.schema import EXTRACTED

    make = lambda *r: spark.createDataFrame(list(r), EXTRACTED)
    t = load.flatten(make(record("b.rs", [("A::m", "A"), ("A", None), ("x", "Z")], [("A", "x")]), record("a.rs", [("Z", None), ("Z", None)])), now=5)
    assert [(r.id, r.file_id, r.qualified_name, r.parent_symbol_id) for r in t["symbols"].orderBy("id").collect()] == [(1, 1, "Z", None), (2, 2, "A::m", 3), (3, 2, "A", None), (4, 2, "x", None)]
    assert [(r.path, r.file_id, r.indexed_at) for r in t["files"].orderBy("file_id").collect()] == [("a.rs", 1, 5), ("b.rs", 2, 5)]
    assert t["calls"].first().caller_symbol_id == 3 and t["imports"].count() == 2
    for bad, strict in ((make(record("a", [("x", None)]), record("a", [])), False), (make(record("a", [("x", None), ("x", None)])), True), (make(record("a", [("x", None)], [("y", "x")])), False), (make(record("a", [("x", None)], [], [("y", "x")])), False)):
        with pytest.raises(load.Rejected):
            load.flatten(bad, strict=strict)
    empty = load.flatten(make())
    assert all(df.count() == 0 for df in empty.values())


def test_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = dense_ids(df, ["g", "k"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 1001)) and [(r.g, r.k) for r in got] == sorted((r.g, r.k) for r in got)
    assert dense_ids(df.limit(0), ["k"]).count() == 0


def test_deletion(spark):
    s = symbols(spark, (1, 1, "a"), (2, 2, "b"))
    c = resolve.calls(calls(spark, (1, "b", 1, 1, 0), (2, "a", 2, 1, 0)), s)
    tables = {"files": files(spark, "a.rs", "b.rs"), "symbols": s, "calls": c, "refs": spark.createDataFrame([(1, 2, 1)], "id bigint, symbol_id bigint, file_id bigint"), "types": spark.createDataFrame([], "id bigint, target_symbol_id bigint, file_id bigint"), "imports": spark.createDataFrame([(1, 1, 2, 2)], "id bigint, file_id bigint, resolved_file_id bigint, resolved_symbol_id bigint")}
    gone = spark.createDataFrame([("b.rs",), ("absent.rs",)], "path string")
    kept = diff.without_files(tables, gone)
    assert [(r.id, r.callee_symbol_id) for r in kept["calls"].collect()] == [(1, None)] and kept["refs"].first().symbol_id is None
    i = kept["imports"].first()
    assert (i.resolved_symbol_id, i.resolved_file_id) == (None, None) and kept["symbols"].count() == kept["files"].count() == 1
    strict = diff.without_files(tables, gone, compat_cascade=True)
    assert strict["calls"].count() == strict["refs"].count() == 0 and strict["imports"].count() == 1
    assert diff.next_ids(tables) == {"files": 3, "symbols": 3, "refs": 2, "calls": 3, "imports": 2, "types": 1}


def test_paths(spark):
    def each(f, *values):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string").orderBy("i").select(f(F.col("p"))).collect()]

    assert each(paths.directory, "a/b/c.rs", "c.rs") == ["a/b", ""] and each(paths.extension, "a.b/c", "x.tar.gz", ".rs", "a/.x", "b.RS") == [None, "gz", None, None, "RS"]
    assert each(paths.host, "https://a.b:80/x", "file:///x", "nothing", "http://ex_ample.org/") == ["a.b", "local", "local", "ex_ample.org"]
    assert each(paths.url_extension, "http://a.org/x.html?y=1.pdf", "http://a.org", "http://a/b.toolongextension", "http://a/b.c-d", "http://a/.md") == ["html", "bin", "bin", "bin", "md"]
    assert each(lambda p: paths.relative(p, "/r\\t"), "/r/t/a\\b", "/other") == ["a/b", "/other"]


def test_ignore_rules():
    ig = Ignore({"": "# note\n*.log\n!keep.log\nbuild/\n/only.rs\na/**/z.rs\nsp\\ ace\n*.t?p\n[ab].rs\n", "sub": "local.rs\n!x.log\n"})
    yes = ["x.log", "d/x.log", "build/x.rs", "d/build/y/x.rs", "only.rs", "a/z.rs", "a/b/c/z.rs", "f.tmp", "a.rs", "sub/local.rs", "sub/deep/local.rs", "sp ace"]
    no = ["keep.log", "build", "d/only.rs", "local.rs", "sub/x.log", "c.rs", "az.rs", "src/main.rs"]
    assert [p for p in yes if not ig.ignored(p)] == [] and [p for p in no if ig.ignored(p)] == []


def test_meter(spark):
    state = counters.parse("# c\n\ninput_tokens = 5\ncalls=x\nunknown=3\nlast_updated_unix=100\nbroken\noutput_tokens=-1\n")
    assert state["input_tokens"] == 5 and state["calls"] == state["output_tokens"] == 0
    state = counters.record(counters.snapshot(state, 1), 10, 2, 200)
    assert counters.difference(state) == {"input_tokens": 10, "output_tokens": 2, "calls": 1} and counters.since(state, 50, 240)["calls"] == 1 and counters.since(state, 30, 240)["calls"] == 0
    assert counters.difference(counters.reset(state)) == dict.fromkeys(meter.COUNTERS, 0)
    assert counters.record({**state, "input_tokens": (1 << 64) - 1}, 5, 0, 1)["input_tokens"] == (1 << 64) - 1
    d = spark.createDataFrame([("90s",), ("5m",), ("2h",), ("1d",), ("x",), ("5",), ("-5s",)], "d string")
    assert [r[0] for r in d.select(meter.seconds(F.col("d"))).collect()] == [90, 300, 7200, 86400, None, None, None]
    assert meter.duration_seconds("2h") == 7200
    many = spark.createDataFrame([(1, (1 << 63) - 1, 1), (1, 5, 1)], "k int, input_tokens bigint, output_tokens bigint")
    assert tuple(meter.totals(many, ["k"]).first()) == (1, (1 << 63) - 1, 2, 2)
    lines = spark.createDataFrame([("a=1",), ("# a=2",), ("a=x",), (" b = 7 ",), ("",)], "value string")
    assert sorted(map(tuple, meter.parse(lines).collect())) == [("a", 1), ("b", 7)]


def test_many_texts_are_looked_up_as_few_are(spark):
    """Looked for by shared runs of letters, many texts find what a scan finds."""
    from symloom.operators import lookup
    from symloom.shared import stored

    names = [(i, f"mod_{i % 5}::Type{i}::get_{i * 7 % 13}", f"get_{i * 7 % 13}") for i in range(60)]
    symbols = spark.createDataFrame(names, "id bigint, qualified_name string, name string")
    texts = ["Type1", "e1", "::", "x", "get_1", "5::", "none of them", "mod_3::Type", "é", "Type59::get_10"]
    asked = stored(spark.createDataFrame([(t,) for t in texts], "q string"), "asked")
    rows = [sorted(map(tuple, lookup._within(symbols, asked, n).collect())) for n in (100, 2)]
    want = sorted((t, 2 if q.endswith(("::" + t, "." + t)) else 3, i) for t in texts for i, q, _ in names if t in q)
    assert rows[0] == rows[1] == want and len(want) > 60


def test_rows_without_a_pointer_stay_where_they_are(spark):
    """They have no key, and a join by it would bring all of them to one task."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("id", "if(id % 2 = 0, NULL, id) AS symbol_id")
    lost = spark.range(1, 100).selectExpr("id AS _lost")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for drop, n in ((False, 2050), (True, 2000)):
            left = diff.pointing(rows, "symbol_id", lost, drop)
            assert left.count() == (3950 if drop else 4000) and left.where("symbol_id IS NULL").count() == n
            most = left.where("symbol_id IS NULL AND id % 2 = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most <= 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_goal_that_nothing_leads_to_is_looked_at_from_its_end(spark, monkeypatch):
    """A search over tables goes on from the end where there is less: none of a long chain's levels is made for a goal beside it."""
    pairs = [(i, i + 1) for i in range(1, 12)] + [(20, 21)]
    e = spark.createDataFrame([(x, y, "call", 1, i, 0) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))], "src bigint, dst bigint, kind string, kind_rank int, row_id bigint, top_id bigint")
    s = symbols(spark, *[(i, 1, f"f{i}") for i in [*range(1, 13), 20, 21, 30]])
    made = []
    monkeypatch.setattr(traverse, "stored", lambda df, tag, f=traverse.stored: made.append(tag) or f(df, tag))
    assert traverse.shortest_path(e, s, 1, 30, on_driver=0) is None and len(made) <= 4
    made.clear()
    assert traverse.shortest_path(e, s, 1, 20, on_driver=0) is None and len(made) <= 12
    assert [n for n, _ in traverse.shortest_path(e, s, 1, 7, on_driver=0)] == [1, 2, 3, 4, 5, 6, 7]
    assert traverse.shortest_path(e, s, 1, 7, most_hops=5, on_driver=0) is None and len(traverse.shortest_path(e, s, 1, 7, most_hops=6, on_driver=0)) == 7


def test_small_frontiers_go_to_the_edges(spark):
    """Edges are not moved for a frontier that can be sent to them, which is what keeps a hop's cost from growing with all edges."""
    e = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst", "'call' AS kind", "1 AS kind_rank", "id AS row_id", "0L AS top_id")
    plan = traverse._neighbours(e, spark.range(2000).toDF("node"), 2000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.node: r.distance for r in traverse.distances(e, 5, 3).collect()} == {5: 0, 6: 1, 7: 2, 8: 3}


def test_neighbours_of_the_hot_and_of_others(spark, monkeypatch):
    """Neighbours come in order of names whether by a window or by ranges, with places of names or without; those of few take no range exchange and no table."""
    n = 300
    s = symbols(spark, (1, 1, "m"), *[(i, 1, f"m::f{i * 7 % n}", 1) for i in range(2, n)])
    c = resolve.calls(calls(spark, *[(i, "m", 1, i, 0) for i in range(2, n, 2)], *[(i, "m", 1, i, 1) for i in range(2, n, 4)], *[(2, f"m::f{i}", 1, 5, 0) for i in range(9)]), s)
    e = graph.edges(s, c, spark.createDataFrame([], "id bigint, symbol_id bigint, target_symbol_id bigint"), spark.createDataFrame([], "id bigint, file_id bigint, resolved_symbol_id bigint"))
    places = dense_ids(s.select("id", "qualified_name"), ["qualified_name", "id"], "place").select("id", "place")
    answer = lambda *more: sorted(map(tuple, verbs.neighbourhood(e, s, *more).select("id", "bucket", "position", "neighbor_id").collect()))
    names = {r.id: r.qualified_name for r in s.collect()}
    kinds = defaultdict(set)
    for r in e.collect():
        inside = names[r.dst].startswith(names[r.src] + "::")
        kinds[r.src, "callees" if r.kind == "call" else "children" if inside else "parents"].add(r.dst)
    wanted = sorted((i, b, k, x) for (i, b), near in kinds.items() for k, x in enumerate(sorted(near, key=lambda x: (names[x], x))))
    made = []
    monkeypatch.setattr(verbs, "dense_ids", lambda *a, f=verbs.dense_ids, **k: made.append(1) or f(*a, **k))
    assert answer() == wanted and answer(places) == wanted and not made
    monkeypatch.setattr(verbs, "HOT", 50_000)
    assert verbs._hot(spark.range(120_000).selectExpr("if(id % 2 = 0, 7, id) AS id", "id AS neighbor_id")) == [7]
    monkeypatch.setattr(verbs, "_hot", lambda e: [1])
    assert answer() == wanted and answer(places) == wanted and made


def test_words_of_a_question_are_found_once(spark, monkeypatch):
    """They are no part of what is computed for each symbol, and many of them score as few do."""
    s = symbols(spark, *[(i, 1, f"m::order_{i}") for i in range(1, 30)])
    asked = "Where is order_12, or Order_1?"
    plan = lookup.scored(s, asked)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "split(" not in plan
    few = sorted(map(tuple, lookup.seeds(s, asked).collect()))
    monkeypatch.setattr(text, "SPELLED_OUT", 1)
    assert sorted(map(tuple, lookup.seeds(s, asked).collect())) == few and few[0][1:] == (12, 150)
    assert lookup.seeds(s, "of a").count() == 0
