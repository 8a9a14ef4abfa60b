"""Go: functions, methods by receiver, types, imports."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, utf8
from symloom.extract.record import Found, gathered, joined

_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BUILTIN_TYPES = set("bool byte rune string error any int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128".split())


def extract(body: str, module: str) -> Found:
    return gathered(pieces(body, module))


def pieces(body: str, module: str) -> Iterator[Found]:
    package = None

    def walk(src: Source) -> Found:
        nonlocal package
        if not src.begin:
            package = next((src.text(src.tokens[i + 1].start, src.tokens[i + 1].stop) for i in range(len(src.tokens) - 1) if src.at(i) == "package"), None)
        if package is None and body.find("package", src.end) >= 0:
            src.past = True  # it may be named later
        out = Found()
        _Walk(src, out, module if package is None else package).file()
        return out

    return lexer.pieces(body, "go", walk)


def visibility(name: str) -> str:
    return "exported" if name[:1].isupper() else "package-private"


class _Walk:
    def __init__(self, src: Source, out: Found, package: str) -> None:
        self.src, self.out, self.package = src, out, package

    def word(self, i: int) -> str:
        return self.src.text(self.src.tokens[i].start, self.src.tokens[i].stop)

    def file(self) -> None:
        src, i, n = self.src, 0, len(self.src.tokens)
        while i < n:
            t = src.at(i)
            if t == "import":
                i = self.imports(i)
            elif t == "func":
                i = self.function(i)
            elif t == "type":
                if src.at(i + 1) == "(":
                    close, k = src.partner[i + 1], i + 2
                    while k < close:
                        k = self.type_spec(k, close, k) if src.is_word(k) else k + 1
                    i = close + 1
                else:
                    i = self.type_spec(i + 1, n, i)
            else:
                i = src.after(i)

    def line(self, i: int) -> int:
        return self.src.position(self.src.tokens[i].start)[0]

    def line_end(self, i: int, stop: int) -> int:
        """The first token of the next line outside brackets, or a semicolon."""
        src = self.src
        while i < stop:
            k = src.after(i)
            if k >= stop or src.at(k) == ";" or src.position(src.tokens[k - 1].stop)[0] < self.line(k) and src.at(k - 1) not in ("|", ",", "="):
                return min(k, stop)
            i = k
        return stop

    def doc(self, i: int) -> str | None:
        src = self.src
        found = []
        for c in src.comments_before(src.tokens[i].start, src.tokens[i - 1].stop if i else 0):
            text = utf8(c.text)
            found.append(text[2:].strip() if text.startswith("//") else text[2:].removesuffix("*/").strip())
        return "\n".join(reversed(found)).strip() or None if found else None

    def function(self, i: int) -> int:
        src, n = self.src, len(self.src.tokens)
        k, receiver = i + 1, None
        if src.at(k) == "(":
            inner = [x for x in range(k + 1, src.partner[k]) if src.is_word(x)]
            square = src.find(k + 1, src.partner[k], "[")
            inner = [x for x in inner if x < square]
            if not inner:
                return src.after(k)
            receiver = self.word(inner[-1])
            k = src.after(k)
        if not src.is_word(k):
            return src.after(k)
        name, params = self.word(k), k + 1
        if src.at(params) == "[":
            params = src.after(params)
        if src.at(params) != "(":
            return k + 1
        j, open_at = src.after(params), None
        while j < n and self.line(j) == src.position(src.tokens[j - 1].stop)[0]:
            if src.at(j) == "{" and src.at(j - 1) not in ("interface", "struct"):
                open_at = j
                break
            j = src.after(j)
        end = src.partner[open_at] if open_at is not None else j - 1
        head = open_at if open_at is not None else end + 1
        parent = joined(self.package, None, receiver) if receiver else None
        qname = joined(self.package, parent, name)
        a = src.tokens[i].start
        self.out.symbol(src, qname, name, "method" if receiver else "function", a, src.tokens[end].stop, parent, src.text(a, src.tokens[head].start).strip() if open_at is not None else None, visibility(name), self.doc(i))
        if receiver:
            self.types_in(i + 1, k)
        self.types_in(k + 1, params)
        self.types_in(params, head)
        if open_at is not None:
            self.inside(open_at + 1, end, qname)
        return end + 1

    def type_spec(self, k: int, stop: int, doc_at: int) -> int:
        src = self.src
        if not src.is_word(k):
            return k + 1
        name = self.word(k)
        b = k + 1
        if src.at(b) == "[" and src.is_word(b + 1) and src.after(b) < stop and src.position(src.tokens[src.after(b)].start)[0] == self.line(k) and src.at(b + 2) != "]":
            b = src.after(b)
        alias = src.at(b) == "="
        b += alias
        end = self.line_end(k, stop)
        a, z = src.tokens[k].start, src.tokens[end - 1].stop
        qname = joined(self.package, None, name)
        kind = "type_alias" if alias else "struct" if src.at(b) == "struct" else "interface" if src.at(b) == "interface" else "type"
        self.out.symbol(src, qname, name, kind, a, z, None, src.text(a, z), visibility(name), self.doc(doc_at))
        if alias and src.is_word(b) and b + 1 == end:
            self.out.relation(qname, "alias_of", self.word(b), self.line(k))
        elif kind == "struct" and src.at(b + 1) == "{":
            self.struct_fields(b + 1, qname)
        elif kind == "interface" and src.at(b + 1) == "{":
            self.interface(b + 1, qname)
        return end

    def struct_fields(self, open_at: int, owner: str) -> None:
        src, i, close = self.src, open_at + 1, self.src.partner[open_at]
        while i < close:
            if src.at(i) == ";":
                i += 1
                continue
            end = self.line_end(i, close)
            last = end - (src.tokens[end - 1].kind == "string")
            first = i + (src.at(i) == "*")
            if src.is_word(first) and last == first + 1:
                self.out.relation(owner, "embeds", self.word(first), self.line(first))
            self.types_in(first if last == first + 1 else i + 1, last)
            i = end

    def interface(self, open_at: int, owner: str) -> None:
        src, i, close = self.src, open_at + 1, self.src.partner[open_at]
        while i < close:
            if src.at(i) == ";":
                i += 1
                continue
            end = self.line_end(i, close)
            if src.is_word(i) and src.at(i + 1) == "(":
                name, a, z = self.word(i), src.tokens[i].start, src.tokens[end - 1].stop
                self.out.symbol(src, joined(self.package, owner, name), name, "method", a, z, owner, src.text(a, z), None, self.doc(i))
                self.types_in(i + 1, end)
            elif src.is_word(i):
                last = i + 2 if src.at(i + 1) == "." else i
                self.out.relation(owner, "extends", src.text(src.tokens[i].start, src.tokens[last].stop), self.line(i))
            i = end

    def imports(self, i: int) -> int:
        src = self.src
        a, b = (i + 2, src.partner[i + 1]) if src.at(i + 1) == "(" else (i + 1, self.line_end(i + 1, len(src.tokens)))
        for k in range(a, b):
            if src.tokens[k].kind == "string":
                before = k - 1
                named = before >= a and src.tokens[before].kind != "string" and src.at(before) not in (";",) and self.line(before) == self.line(k)
                self.out.imported(self.word(k)[1:-1], self.word(before) if named else None, self.line(k))
        return b + (src.at(i + 1) == "(")

    def types_in(self, i: int, stop: int) -> None:
        """Names that stand where a type does: the last of a run of words, or one after *, ], ..., a bracket or a package."""
        src = self.src
        for k in range(i, stop):
            t = src.tokens[k]
            if t.kind != "word" or t.text in _KEYWORDS or src.at(k + 1) == ".":
                continue
            after = src.at(k + 1) if k + 1 < stop else ")"
            before = src.at(k - 1)
            if src.is_word(k + 1) and k + 1 < stop and self.line(k + 1) == self.line(k) or after in ("*", "[", "...") or (src.at(k + 1) in ("func", "map", "chan", "interface", "struct") and k + 1 < stop):
                if before not in ("*", "]", ".", "...") or src.is_word(k + 1):
                    continue
            if after == "," and before in ("(", ",") and self.named_list(k, stop):
                continue
            self.out.ref(src, self.word(k), "type", t.start, t.stop)

    def named_list(self, k: int, stop: int) -> bool:
        """Whether a parameter without a type of its own takes that of a later one."""
        src = self.src
        while k < stop and src.is_word(k) and src.at(k + 1) == ",":
            k += 2
        return k < stop and src.is_word(k) and (src.is_word(k + 1) or src.at(k + 1) in ("*", "[", "...")) and k + 1 < stop

    def type_end(self, i: int, stop: int) -> int:
        """Past the type that begins at i."""
        src = self.src
        while i < stop:
            t = src.at(i)
            if t in ("*", "<-", "chan"):
                i += 1
            elif t == "[":
                i = src.after(i)
            elif t == "map" and src.at(i + 1) == "[":
                i = src.after(i + 1)
            elif t == "func":
                return self.header_end(i, stop)
            elif t in ("struct", "interface") or t == "(":
                return src.after(i + (t != "("))
            elif src.is_word(i):
                i += 3 if src.at(i + 1) == "." else 1
                return src.after(i) if src.at(i) == "[" and src.is_word(i + 1) and src.after(i) <= stop else i
            else:
                return i
        return i

    def header_end(self, i: int, stop: int) -> int:
        """Past the parameters and results of a function that begins with func at i and has no name."""
        src = self.src
        i = src.after(i + 1) if src.at(i + 1) == "(" else i + 1
        return self.type_end(i, stop) if i < stop and (src.is_word(i) and src.at(i) not in ("in",) or src.at(i) in ("(", "*", "[", "<-")) else i

    def body_types(self, i: int, stop: int) -> list[tuple[int, int]]:
        """Where types stand in a body, apart from literals and variables: of assertions, type switches, function literals, make and new, and arguments of generics."""
        src, out = self.src, []
        for k in range(i, stop):
            t = src.at(k)
            if t == "." and src.at(k + 1) == "(" and src.at(k + 2) != "type":
                out.append((k + 2, src.partner.get(k + 1, k + 1)))
            elif t in ("make", "new") and src.at(k + 1) == "(" and src.at(k - 1) != ".":
                out.append((k + 2, self.type_end(k + 2, src.partner.get(k + 1, k + 1))))
            elif t == "func" and src.at(k + 1) == "(":
                out.append((k + 1, self.header_end(k, stop)))
            elif t == "map" and src.at(k + 1) == "[" or t == "[" and src.at(k + 1) == "]" and src.at(k - 1) in ("(", ",", "=", ":=", "return", "{", ":", "&"):
                out.append((k + 1, self.type_end(k, stop)))
            elif t == "[" and src.is_word(k - 1) and src.at(src.after(k)) in ("(", "{") and all(src.at(x)[:1].isupper() or src.at(x) in _BUILTIN_TYPES for x in range(k + 1, src.partner.get(k, k)) if src.is_word(x)):
                out.append((k, src.after(k)))
            elif t == "switch":
                open_at = src.find(k, stop, "{")
                if any(src.at(x) == "type" and src.at(x - 1) == "(" and src.at(x - 2) == "." for x in range(k, min(open_at, stop))):
                    close, x = src.partner.get(open_at, stop), open_at + 1
                    while x < close:
                        if src.at(x) == "case":
                            out.append((x + 1, src.find(x, close, ":")))
                        x = src.after(x)
        return out

    def inside(self, i: int, stop: int, caller: str) -> None:
        src = self.src
        before = len(self.out.refs)
        for a, b in self.body_types(i, stop):
            if src.at(a - 1) == "case":
                while a < b:
                    end = src.find(a, b, ",")
                    self.types_in(a, end)
                    a = end + 1
            else:
                self.types_in(a, b)
        done = {(r["line"], r["col"]) for r in self.out.refs[before:]}
        for k in range(i, stop):
            t = src.tokens[k]
            if t.kind != "word" or t.text in _KEYWORDS or src.position(t.start) in done:
                continue
            called = k + 1
            if src.at(called) == "[" and src.at(src.after(called)) == "(" and (called, src.after(called)) in set(self.body_types(k, called + 1)):
                called = src.after(called)
            if src.at(called) == "(":
                if t.text in _BUILTIN_TYPES:
                    continue
                start = k
                while start > i and src.at(start - 1) == ".":
                    p = start - 2
                    while p >= i and src.at(p) in (")", "]"):
                        p = src.partner.get(p, p) - 1
                    if p < i or not src.is_word(p):
                        start = max(p + 1, i)
                        break
                    start = p
                name = self.word(k)
                self.out.call(src, caller, name, src.tokens[start].start)
                self.out.ref(src, name, "call", src.tokens[start].start, src.tokens[src.partner.get(called, called)].stop)
            elif src.at(called) == "{" and (t.text[0].isupper() or src.at(k - 1) == "]") and src.at(k - 1) not in ("range",):
                self.out.ref(src, self.word(k), "type", t.start, t.stop)
            elif src.at(k - 1) in ("var", "const") and called < stop and self.line(called) == self.line(k):
                end = min(src.find(called, self.line_end(k, stop), "="), self.line_end(k, stop))
                self.types_in(called, end)
