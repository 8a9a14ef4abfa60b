"""Answers as Markdown."""

from __future__ import annotations

_FENCE = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp"}
_IMPORT = {"rs": "use ", "py": "import "}


def _ext(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2]


def _bullet(n) -> str:
    return f"- `{n.qualified_name}` ({n.kind}) — `{n.path}:{n.start_line}`"


def _lines(*parts: str) -> str:
    return "".join(p + "\n" for p in parts)


def query(answer: dict) -> str:
    out = _lines(f"# Query: {answer['question']}", "")
    if not answer["seeds"]:
        return out + _lines("_No symbols matched the question. " + "Try a more specific name or qualifier._")
    seeds, rest = answer["nodes"][: answer["seeds"]], answer["nodes"][answer["seeds"] :]
    out += _lines(f"## Seeds ({len(seeds)})", *map(_bullet, seeds), "")
    if rest:
        out += _lines(f"## Expanded ({len(rest)})")
        for path in sorted({n.path for n in rest}):
            out += _lines(f"- `{path}`", *[f"  - `{n.qualified_name}` ({n.kind}) — line {n.start_line}" for n in sorted((n for n in rest if n.path == path), key=lambda n: n.start_line)])
        out += "\n"
    if answer["n_edges"]:
        out += _lines("## Edges traversed", "- " + " / ".join(f"{answer['edges'].get(k, 0)} {k}" for k in ("parent", "call", "type", "import")), "")
    return out + _lines(f"_traversal: {answer['mode']}, budget: {answer['budget']} tokens, est: {answer['used']} tokens, nodes: {len(answer['nodes'])}, edges: {answer['n_edges']}_")


def _fenced(path: str, rows: list[str]) -> str:
    return _lines(f"```{_FENCE.get(_ext(path), '')}", *rows, "```", "")


def _signature_and_body(answer: dict) -> str:
    f, out = answer["focus"], ""
    if f.signature:
        out += _lines("**Signature**", "") + _fenced(f.path, [f.signature])
    if answer["body"]:
        cut = ", truncated to fit budget" if answer["truncated"] else ""
        out += _lines(f"**Body** ({len(answer['body'])} lines{cut})", "") + _fenced(f.path, answer["body"])
    elif answer["truncated"]:
        out += _lines("_Body omitted — budget too tight for any body lines._", "")
    return out


def follow(asked: str, answer: dict) -> str:
    f = answer["focus"]
    out = _lines(f"# Follow: `{f.qualified_name}`", "", f"**Kind:** {f.kind} • **Language:** {f.language} • **File:** `{f.path}:{f.start_line}` • **Resolved from:** `{asked}`", "")
    if f.doc_comment:
        out += _lines("**Doc**", "", *[f"> {x}" for x in f.doc_comment.splitlines()], "")
    out += _signature_and_body(answer)
    if answer["callers"]:
        return out + _lines(f"**Callers** ({len(answer['callers'])} shown)", *map(_bullet, answer["callers"]), "")
    return out + _lines("_No callers recorded in the index._", "")


def refs(asked: str, limit: int, answer: dict) -> str:
    f, n = answer["focus"], len(answer["sites"])
    out = _lines(f"# Refs: `{f.qualified_name}`", "", f"**Kind:** {f.kind} • **Defined at:** `{f.path}:{f.start_line}` • **Resolved from:** `{asked}`", "")
    if not n:
        return out + _lines("_No references recorded in the index._", "")
    more = f" (showing first {n}, more exist past --limit {limit})" if answer["truncated"] else ""
    out += _lines(f"**{n} reference site{'' if n == 1 else 's'}{more}**", "")
    for caller, site in answer["sites"]:
        who = f"`{caller.qualified_name}` ({caller.kind})" if caller else "_<module-level>_"
        out += _lines(f"- [{site.kind}] {who} → `{site.path}:{site.line}`")
    return out + "\n"


def explain(answer: dict) -> str:
    f = answer["focus"]
    out = _lines(f"# Explain: `{f.qualified_name}`", "", f"**Kind:** {f.kind} • **File:** `{f.path}:{f.start_line}`", "")
    names = {"parents": "parent", "children": "child", "callers": "caller", "callees": "callee", "types": "type", "imports": "import"}
    total = sum(len(answer[b]) for b in names)
    if not total:
        return out + _lines(f"_This symbol has no {', '.join(list(names)[:4])}, type relations, or imports recorded in the index._")
    out += _lines(f"**Neighbors:** {total} total ({' / '.join(f'{len(answer[b])} {one}' for b, one in names.items())})", "")
    for b in names:
        if answer[b]:
            out += _lines(f"## {b.capitalize()} ({len(answer[b])})", *map(_bullet, answer[b]), "")
    return out


def path(start: str, goal: str, found: list | None) -> str:
    out = _lines(f"# Path: {start} → {goal}", "")
    if found is None:
        return out + _lines("_No path found between the two symbols._")
    if len(found) == 1:
        return out + _lines("_Source and destination are the same symbol._", _bullet(found[0][0]))
    hops = len(found) - 1
    out += _lines(f"**Distance:** {hops} edge{'' if hops == 1 else 's'}", "", "## Hops")
    for i, (n, _) in enumerate(found):
        out += _lines(f"{i + 1}. {_bullet(n)[2:]}")
        if i < hops:
            out += _lines(f"   → via {found[i + 1][1]}")
    return out + "\n"


def slice_(location: str, answer: dict) -> str:
    f = answer["focus"]
    out = _lines(f"# Slice: `{location}`", "", f"**Encloses:** `{f.qualified_name}` ({f.kind}) • **File:** `{f.path}:{f.start_line}`", "")
    if answer["imports"]:
        prefix = _IMPORT.get(_ext(f.path), "")
        out += _lines(f"**Imports** ({len(answer['imports'])} shown)", "") + _fenced(f.path, [f"{prefix}{x};" for x in answer["imports"]])
    return out + _signature_and_body(answer)


def map_(answer: dict) -> str:
    root = answer["root"]
    out = _lines(f"# Map: {answer['scope'] or '<project root>'}", "", f"**Files:** {root['files']} • **Symbols:** {root['symbols']} • **Depth:** {answer['depth']}", "")

    def node(n: dict, lead: str, joint: str, inner: str) -> str:
        label = n["path"].rpartition("/")[2] or "."
        text = _lines(f"{lead}{joint}{label}/  ({n['files']} files, {n['symbols']} symbols)")
        if n["kinds"]:
            text += _lines(f"{inner}kinds: {', '.join(f'{k}={c}' for k, c in n['kinds'][:5])}")
        if n["top"]:
            text += _lines(f"{inner}top:", *[f"{inner}  - {s['qualified_name']} ({s['kind']}) — {s['path']}:{s['start_line']} [{s['caller_count']} caller{'' if s['caller_count'] == 1 else 's'}]" for s in n["top"]])
        for i, child in enumerate(n["children"]):
            last = i == len(n["children"]) - 1
            text += node(child, inner, "└── " if last else "├── ", inner + ("    " if last else "│   "))
        return text

    return out + node(root, "", "", "")


def meter(state: dict, label: str, counters: dict) -> str:
    out = _lines("# Meter", "", f"**{label}**", "", f"- input_tokens:  {counters['input_tokens']}", f"- output_tokens: {counters['output_tokens']}", f"- calls:         {counters['calls']}")
    return out + (_lines(f"- last_updated:  unix {state['last_updated_unix']}") if state["last_updated_unix"] else "")
