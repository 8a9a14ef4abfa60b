"""Python by its own syntax tree; a text that has errors is read as far as its blocks can be."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

from symloom.extract.record import Found, gathered, joined

_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)
#: Lines that an error is in become one of these, so that what is around them can be read.
_HEADS = [(re.compile(rb"except\b"), b"except:"), (re.compile(rb"finally\b"), b"finally:"), (re.compile(rb"elif\b"), b"elif 1:"), (re.compile(rb"else\b"), b"else:")]
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)


#: Bytes that a piece of a file has at least, what the line after it begins with, and what lets a file be read only as one.
PIECE = 1 << 20
_DECLARED = re.compile(rb"^(?:class|def|async def|import|from|@)", re.M)
_AS_ONE = re.compile(rb"\A(?:\xef\xbb\xbf|[^\n]*\n?[ \t\f]*#[^\n]*coding[:=])|\r(?!\n)")


def extract(body: str, module: str) -> Found:
    """body: bytes as Latin-1."""
    return gathered(pieces(body, module))


def pieces(body: str, module: str, most: int | None = None) -> Iterator[Found]:
    """What the pieces of a file hold, in order; only one piece's tree is held at a time."""
    data = body.encode("latin-1")
    walk = _Walk(data, Found(), module)
    try:
        cuts = _cuts(data, most or PIECE)
    except _ERRORS:
        walk.broken()
        yield walk.found()
        return
    line = 0
    for a, b in cuts:
        walk.block(ast.increment_lineno(ast.parse(data[a:b]), line).body, None, "module")
        yield walk.found()
        line += data.count(b"\n", a, b)


def _cuts(data: bytes, most: int) -> list[tuple[int, int]]:
    """Where pieces begin and end that can be read each by itself: what ends where a declaration's line begins, and has no errors, is a run of whole statements."""
    if len(data) <= most or _AS_ONE.search(data):
        ast.parse(data)
        return [(0, len(data))]
    out, a, n = [], 0, most
    while a < len(data):
        m = _DECLARED.search(data, a + n) if a + n < len(data) else None
        b = m.start() if m else len(data)
        try:
            ast.parse(data[a:b])
        except _ERRORS:
            if b == len(data):
                raise
            n = max(b - a, n) * 2
            continue
        out.append((a, b))
        a, n = b, most
    return out


class _Walk:
    def __init__(self, data: bytes, out: Found, module: str) -> None:
        self.data, self.out, self.module = data, out, module
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", data))]

    def place(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")

    def source(self, node: ast.AST) -> str:
        return self.text(self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset))

    def block(self, body: list[ast.stmt], parent: str | None, scope: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                qname = self.define(node, parent, "method" if scope == "class" else "function")
                self.function(node, qname)
            elif isinstance(node, ast.ClassDef):
                qname = self.define(node, parent, "class")
                for base in node.bases:
                    target = base.value if isinstance(base, ast.Starred) else base
                    self.out.relation(qname, "extends", self.source(target), base.lineno)
                self.block(node.body, qname, "class")
            elif isinstance(node, ast.Import):
                for a in node.names:
                    self.out.imported(a.name, a.asname, node.lineno)
            elif isinstance(node, ast.ImportFrom):
                base = "." * node.level + (node.module or "")
                for a in node.names:
                    sep = "" if not base or base.endswith(".") else "."
                    self.out.imported(f"{base}{sep}{a.name}", a.asname, node.lineno)
            elif isinstance(node, (ast.If, ast.Try)):
                pass  # what stands under a condition is no declaration of the module

    def define(self, node, parent: str | None, kind: str) -> str:
        qname = joined(self.module, parent, node.name, ".")
        a, b = self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)
        first = node.body[0]
        body_at = min([self.place(first.lineno, first.col_offset), *[self.place(d.lineno, d.col_offset) - 1 for d in getattr(first, "decorator_list", [])]])
        doc = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None
        head = self.text(a, body_at)
        colon = head.rfind(":")
        signature = head[: colon if colon >= 0 else None]
        signature = re.sub(r"[ \t]*#[^\n]*$", "", signature).strip().rstrip(":").strip()
        self.symbol(qname, node.name, kind, a, b, (node.lineno, node.col_offset, node.end_lineno, node.end_col_offset), parent, signature, self.docstring(first) if doc is not None else None)
        return qname

    def docstring(self, node: ast.Expr) -> str | None:
        raw = self.source(node)
        m = re.fullmatch(r"[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1", raw, re.S)
        text = m[2] if m else raw
        return "\n".join(x.lstrip() for x in text.strip().split("\n")).strip() or None

    def symbol(self, qname: str, name: str, kind: str, a: int, b: int, span: tuple, parent: str | None, signature: str | None, doc: str | None) -> None:
        sl, sc, el, ec = span
        self.out.symbols.append({"qualified_name": qname, "name": name, "kind": kind, "start_line": sl, "start_col": sc, "end_line": el, "end_col": ec, "body_start_byte": a, "body_end_byte": b, "signature": signature or None, "visibility": None, "parent_qualified_name": parent, "doc_comment": doc})

    def function(self, node, qname: str) -> None:
        """Calls and annotations anywhere in a function, inner ones included."""
        outside = {id(x) for d in node.decorator_list for x in ast.walk(d)}
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and id(x) not in outside:
                self.out.calls.append({"caller_qualified_name": qname, "callee_raw_name": self.source(x.func), "line": x.lineno, "col": x.col_offset})
            for field in ("annotation", "returns"):
                note = getattr(x, field, None)
                if isinstance(note, ast.AST):
                    for n in ast.walk(note):
                        if isinstance(n, ast.Name):
                            self.out.refs.append({"line": n.lineno, "col": n.col_offset, "end_line": n.end_lineno, "end_col": n.end_col_offset, "kind": "type", "raw_name": n.id})

    def found(self) -> Found:
        """What was found since this was asked last, its calls and references by place: sorted once, not once a function."""
        out, self.out = self.out, Found()
        for rows in (out.calls, out.refs):
            rows.sort(key=lambda r: (r["line"], r["col"]))
        return out

    def broken(self) -> None:
        """Block after block of lines; of a block with errors what is left without the lines that they are in, and where that fails its definitions."""
        lines = self.data.split(b"\n")
        at = [i for i, x in enumerate(lines) if x[:1].strip() and x[:1] not in b"#)]}\"'" and not re.match(rb"(?:else|elif|except|finally)\b", x)]
        cuts = sorted({0, *(i for j, i in enumerate(at) if not (j and lines[at[j - 1]][:1] == b"@"))}) + [len(lines)]
        for a, b in zip(cuts, cuts[1:]):
            tree = self.repaired(lines, a, b)
            if tree is None:
                self.definitions(a, b)
            else:
                self.block(tree.body, None, "module")

    def repaired(self, lines: list[bytes], a: int, b: int) -> ast.Module | None:
        """The tree of lines [a, b), which keep their numbers, after as many repairs as it has lines."""
        own = lines[a:b]
        for _ in range(len(own) + 1):
            text = b"\n" * a + b"\n".join(own)
            try:
                return ast.parse(text)
            except SyntaxError as e:
                bad = (e.lineno or 0) - 1 - a
                bad = min(max(bad, 0), len(own) - 1)
                if own[bad].strip() in (b"", b"pass"):  # what an error is told after
                    bad = max((i for i in range(bad) if own[i].strip() not in (b"", b"pass")), default=-1)
                if bad < 0:
                    return None
                if not own[bad].isascii():  # bytes that are no text
                    try:
                        own[bad].decode()
                    except UnicodeDecodeError:
                        own[bad] = re.sub(rb"[\x80-\xff]", b"_", own[bad])
                        continue
                if _DEF.match(own[bad].decode("utf-8", "replace")):
                    return None
                body = own[bad].lstrip()
                indent = own[bad][: len(own[bad]) - len(body)]
                head = next((new for old, new in _HEADS if old.match(body)), None)
                new = indent + (head or (b"if 1:" if body.rstrip().endswith(b":") else b"pass"))
                own[bad] = new if new != own[bad].rstrip() else indent + b"pass"
            except (ValueError, RecursionError, MemoryError):
                return None
        return None

    def definitions(self, a: int, b: int) -> None:
        """Definitions that begin in lines [a, b) by their lines and indentation, without what lies within."""
        text = self.data.decode("utf-8", "replace")
        lines = text.split("\n")
        open_: list[tuple[int, str, str]] = []
        for m in _DEF.finditer(text):
            depth, kind, name = len(m[1].expandtabs()), m[2], m[3]
            line = text.count("\n", 0, m.start(2)) + 1
            if not a < line <= b:
                continue
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            if any(k == "def" for _, k, _ in open_):
                continue
            parent = open_[-1][2] if open_ else None
            if not parent and depth:
                continue
            qname = joined(self.module, parent, name, ".")
            end = line
            for j in range(line, len(lines)):
                stripped_ = lines[j].strip()
                if stripped_ and len(lines[j].expandtabs()) - len(lines[j].expandtabs().lstrip()) <= depth:
                    break
                if stripped_:
                    end = j + 1
            col = len(m[1].encode())
            start = self.starts[line - 1] + col
            stop = self.starts[end - 1] + len(lines[end - 1].rstrip("\r").encode())
            signature = lines[line - 1].strip().rstrip(":").strip()
            self.symbol(qname, name, "class" if kind == "class" else "method" if parent else "function", start, stop, (line, col, end, stop - self.starts[bisect_right(self.starts, max(stop - 1, 0)) - 1]), parent, signature, None)
            open_.append((depth, kind, qname))
