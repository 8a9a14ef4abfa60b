"""Java: types, members and what their headers, fields and results refer to."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, utf8
from symloom.extract.record import Found, gathered

_MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_SKIPPED = set("int long short byte float double boolean char void String".split())
_TYPES = {"class": "class", "interface": "interface", "enum": "enum"}
_CONTROL = set("if for while switch catch return new throw synchronized assert else do try case super this".split())


def extract(body: str, module: str) -> Found:
    return gathered(pieces(body, module))


def pieces(body: str, module: str) -> Iterator[Found]:
    prefix = None

    def walk(src: Source) -> Found:
        nonlocal prefix
        out = Found()
        walk, n = _Walk(src, out), len(src.tokens)
        if not src.begin:
            k = next((i for i in range(n) if src.at(i) == "package"), None)
            prefix = walk.text(k + 1, src.find(k, n, ";")) if k is not None else None
        if prefix is None and body.find("package", src.end) >= 0:
            src.past = True  # it may be named later
        walk.types(0, n, prefix or "")
        return out

    return lexer.pieces(body, "java", walk)


def named(prefix: str, name: str) -> str:
    return f"{prefix}::{name}" if prefix else name


class _Walk:
    def __init__(self, src: Source, out: Found) -> None:
        self.src, self.out = src, out

    def text(self, a: int, b: int) -> str:
        """Tokens [a, b) as they stand."""
        return self.src.span(a, b)

    def one_line(self, a: int, b: int) -> str:
        return " ".join(self.text(a, b).split())

    def modifiers(self, i: int, stop: int) -> tuple[int, str | None]:
        src, a = self.src, i
        while i < stop:
            if src.at(i) == "@" and src.at(i + 1) != "interface":
                i += 2
                while src.at(i) == ".":
                    i += 2
                if src.at(i) == "(":
                    i = src.after(i)
            elif src.at(i) in _MODIFIERS and not (src.at(i) == "default" and src.at(i + 1) in (":", "->")):
                i += 1
            elif src.at(i) == "non" and src.at(i + 1) == "-" and src.at(i + 2) == "sealed":
                i += 3
            else:
                break
        mods = self.text(a, i)
        return i, next((v for v in ("public", "protected", "private") if v in mods), None)

    def doc(self, i: int) -> str | None:
        src, out = self.src, []
        for c in src.comments_before(src.tokens[i].start, src.tokens[i - 1].stop if i else 0):
            text = utf8(c.text)
            if text.startswith("/**"):
                rows = [r.strip() for r in text[3:].removesuffix("*/").split("\n")]
                cleaned = "\n".join(r[1:].strip() if r.startswith("*") else r for r in rows).strip()
                if cleaned:
                    out.append(cleaned)
        return "\n".join(reversed(out)) or None

    def types(self, i: int, stop: int, prefix: str) -> None:
        src = self.src
        while i < stop:
            if src.at(i) == "import":
                end = src.find(i, stop, ";")
                static = src.at(i + 1) == "static"
                path = self.text(i + 1 + static, end).replace(" ", "")
                self.out.imported(("static " if static else "") + path, None, src.position(src.tokens[i].start)[0])
                i = end + 1
                continue
            k, vis = self.modifiers(i, stop)
            if src.at(k) in _TYPES or src.at(k) == "@" and src.at(k + 1) == "interface":
                i = self.type(i, k, stop, prefix, None, vis, self.doc(i))
            elif self.is_record(k):
                i = self.after_record(k, stop)
            else:
                i = max(src.after(k), i + 1)

    def type(self, i: int, k: int, stop: int, prefix: str, parent: str | None, vis: str | None, doc: str | None, bodies: bool = True) -> int:
        src, out = self.src, self.out
        annotation = src.at(k) == "@"
        name_at = k + 1 + annotation
        open_at = src.find(name_at, stop, "{")
        if not src.is_word(name_at) or open_at >= stop:
            return k + 1
        kind = "annotation" if annotation else _TYPES[src.at(k)]
        close, name = src.partner[open_at], self.text(name_at, name_at + 1)
        qname = named(prefix, name)
        out.symbol(src, qname, name, kind, src.tokens[i].start, src.tokens[close].stop, parent, self.one_line(i, open_at), vis, doc)
        h = src.skip_angles(name_at + 1, open_at)
        keep = not (kind == "enum" and parent)
        if keep:
            self.references(h, open_at, qname)
        start = open_at + 1
        if kind == "enum":
            start = self.constants(start, close, qname)
        self.members(start, close, qname, name)
        return close + 1

    def references(self, i: int, stop: int, owner: str) -> None:
        """Every named type in a header: generic ones as written, and the names in them each."""
        src, k = self.src, i
        while k < stop:
            if src.is_word(k) and src.at(k) not in ("extends", "implements", "permits"):
                node, k = self.type_at(k, stop)
                self.referred(node, owner)
            else:
                k += 1

    def inner_references(self, i: int, stop: int, owner: str) -> None:
        """The named types within the type of a member: of a type without arguments or dimensions none."""
        if i < stop:
            for child in self.type_at(i, stop)[0][2]:
                self.referred(child, owner)

    def type_at(self, i: int, stop: int) -> tuple[tuple[int, int, list], int]:
        """The type that begins at i as (first token, end, inner types), and where it ends. Inner types are those of a path, arguments and elements."""
        src = self.src
        while src.at(i) == "@":
            i = self.modifiers(i, stop)[0]
        node, k = (i, i + 1, []), i + 1
        while k < stop:
            if src.at(k) == "<" and (past := src.skip_angles(k, stop)) > k:
                inner, x = [], k + 1
                while x < past - 1:
                    if src.is_word(x) and src.at(x) not in ("extends", "super"):
                        child, x = self.type_at(x, past - 1)
                        inner.append(child)
                    else:
                        x += 1
                node, k = (i, past, [node, *inner]), past
            elif src.at(k) == "." and src.is_word(k + 1):
                node, k = (i, k + 2, [node, (k + 1, k + 2, [])]), k + 2
            elif src.at(k) == "[" and src.at(k + 1) == "]":
                node, k = (i, k + 2, [node]), k + 2
            else:
                break
        return node, k

    def referred(self, node: tuple[int, int, list], owner: str) -> None:
        a, b, inner = node
        name = self.text(a, b)
        if name not in _SKIPPED and self.src.at(b - 1) != "]":
            self.out.relation(owner, "references", name, self.src.position(self.src.tokens[a].start)[0])
        for child in inner:
            self.referred(child, owner)

    def constants(self, i: int, close: int, owner: str) -> int:
        src = self.src
        while i < close and src.at(i) != ";":
            if src.at(i) == ",":
                i += 1
                continue
            k, _ = self.modifiers(i, close)
            if not src.is_word(k):
                return i
            end, name = k + 1, self.text(k, k + 1)
            if src.at(end) == "(":
                end = src.after(end)
            body = end if src.at(end) == "{" else None
            if body is not None:
                end = src.after(body)
            qname = named(owner, name)
            self.out.symbol(src, qname, name, "enum_constant", src.tokens[i].start, src.tokens[end - 1].stop, owner, self.text(i, end), None, self.doc(i))
            if body is not None:
                self.members(body + 1, src.partner[body], qname, name)
            i = end
        return i + 1

    def members(self, i: int, stop: int, owner: str, type_name: str) -> None:
        src, out = self.src, self.out
        while i < stop:
            if src.at(i) in (";", ","):
                i += 1
                continue
            k, vis = self.modifiers(i, stop)
            if k >= stop:
                return
            if src.at(k) in _TYPES and src.is_word(k + 1) or src.at(k) == "@" and src.at(k + 1) == "interface":
                i = self.type(i, k, stop, owner, owner, vis, None)
                continue
            if src.at(k) == "{":
                i = src.after(k)
                continue
            if self.is_record(k):
                i = self.after_record(k, stop)
                continue
            t = src.skip_angles(k, stop)
            while src.at(t) == "@":  # of the result's type
                t = self.modifiers(t, stop)[0]
            if src.is_word(t) and src.at(t + 1) == "(" and src.at(t) == type_name.split(".")[-1]:
                i = self.callable(i, t, t, stop, owner, vis, "constructor")
                continue
            name_at = self.type_at(t, stop)[1] if src.is_word(t) else t
            if name_at >= stop or not src.is_word(name_at) or name_at == t:
                end = src.find(t, stop, ";", "{", "=", "(", ",")
                if end >= stop:
                    return
                i = max(src.after(end), i + 1)
                continue
            if src.at(name_at + 1) == "(":
                after = self.callable(i, name_at, t, stop, owner, vis, "method")
                self.inner_references(t, name_at, owner)
                i = after
                continue
            stop_at = src.find(name_at, stop, ";")
            last = min(stop_at, stop - 1)
            for at in self.declared(name_at, stop_at):
                name = self.text(at, at + 1)
                out.symbol(src, named(owner, name), name, "field", src.tokens[i].start, src.tokens[last].stop, owner, self.one_line(i, last + 1), vis, None)
            self.inner_references(t, name_at, owner)
            i = stop_at + 1

    def declared(self, i: int, stop: int) -> list[int]:
        """The names of a field declaration that begin at i: the first, and those after a comma that no argument of a type or call is before."""
        src, out = self.src, []
        while i < stop:
            if src.is_word(i) and src.at(i + 1) in ("=", ",", ";", "[") or i + 1 >= stop and src.is_word(i):
                out.append(i)
            k = src.find(i, stop, "=", ",")
            if src.at(k) == "=" and k < stop:
                while k < stop and src.at(k) != ",":
                    past = src.skip_angles(k, stop)
                    k = past if past > k and src.at(past) in ("(", "[", "::", "{", ".") else src.after(k)
            i = k + 1
        return out

    def is_record(self, k: int) -> bool:
        src = self.src
        return src.at(k) == "record" and src.is_word(k + 1) and src.at(src.skip_angles(k + 2, len(src.tokens))) == "("

    def after_record(self, k: int, stop: int) -> int:
        """Records and what is in them are no symbols."""
        src = self.src
        open_at = src.find(k, stop, "{")
        return src.after(open_at) if open_at < stop else stop

    def callable(self, i: int, name_at: int, type_at: int, stop: int, owner: str, vis: str | None, kind: str) -> int:
        src = self.src
        end = src.find(src.after(name_at + 1), stop, "{", ";")
        name = self.text(name_at, name_at + 1)
        qname = named(owner, name)
        has_body = src.at(end) == "{" and end < stop
        close = src.partner[end] if has_body else min(end, stop - 1)
        self.out.symbol(src, qname, name, kind, src.tokens[i].start, src.tokens[close].stop, owner, self.one_line(i, end if has_body else close + 1), vis, None)
        if has_body:
            self.inside(end + 1, close, qname)
        return close + 1

    def inside(self, i: int, stop: int, caller: str) -> None:
        src = self.src
        for k in range(i, stop):
            if src.at(k) == "new" and src.is_word(k + 1):
                last = k + 1
                while src.at(last + 1) == "." and src.is_word(last + 2):
                    last += 2
                past = src.skip_angles(last + 1, stop)
                if src.at(past) == "(":
                    self.out.call(src, caller, "new " + self.text(k + 1, past), src.tokens[k].start)
            elif src.is_word(k) and src.at(k + 1) == "(" and src.at(k) not in _CONTROL:
                start = k
                while start > i and src.at(start - 1) == ".":
                    p = start - 2
                    if src.at(p) == ">":
                        break
                    while p >= i and src.at(p) in (")", "]"):
                        p = src.partner.get(p, p) - 1
                    if p < i or not (src.is_word(p) or src.tokens[p].kind == "string"):
                        start = max(p + 1, i)
                        break
                    start = p
                before = src.at(start - 1)
                if before == "new" and start == k or start > i and before == "new" and src.at(k - 1) == "." and src.at(k - 2) != ")":
                    continue
                self.out.call(src, caller, self.text(k, k + 1), src.tokens[start].start)
