"""Dart: functions, classes, mixins, enums, extensions and their members."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, utf8
from symloom.extract.record import Found, gathered, joined

_CONTROL = set("if for while switch catch return assert await yield throw new else do try case super this is as in var final const rethrow break continue default with on late".split())
_BUILTIN = set("int double num bool String void dynamic var final const late static required covariant external abstract get set async sync factory operator null true false this super".split())
_MODIFIERS = set("static external abstract late final const covariant var".split())


def extract(body: str, module: str) -> Found:
    return gathered(pieces(body, module))


def pieces(body: str, module: str) -> Iterator[Found]:
    library = None

    def walk(src: Source) -> Found:
        nonlocal library
        out = Found()
        walk, n = _Walk(src, out, module), len(src.tokens)
        if not src.begin:
            k = next((i for i in range(n) if src.at(i) == "library" and src.at(i - 1) in ("", ";", ")")), None)
            library = None if k is None else walk.text(k + 1, src.find(k, n, ";")) if src.is_word(k + 1) else module
        if library is None and body.find("library", src.end) >= 0:
            src.past = True  # it may be named later
        walk.module = module if library is None else library
        walk.file(0, n)
        return out

    return lexer.pieces(body, "dart", walk)


class _Walk:
    def __init__(self, src: Source, out: Found, module: str) -> None:
        self.src, self.out, self.module = src, out, module

    def text(self, a: int, b: int) -> str:
        return self.src.span(a, b)

    def doc(self, i: int) -> str | None:
        src, out = self.src, []
        for c in src.comments_before(src.tokens[i].start, src.tokens[i - 1].stop if i else 0):
            text = utf8(c.text)
            if text.startswith("///"):
                out.append(text[3:].strip())
            elif text.startswith("/**"):
                rows = [r.strip() for r in text[3:].removesuffix("*/").split("\n")]
                out.append("\n".join(r[1:].strip() if r.startswith("*") else r for r in rows).strip())
        return "\n".join(reversed(out)) or None

    def file(self, i: int, stop: int) -> None:
        src, out = self.src, self.out
        while i < stop:
            while src.at(i) == "@":
                i += 2
                while src.at(i) == ".":
                    i += 2
                if src.at(i) == "(":
                    i = src.after(i)
            t = src.at(i)
            if t in ("import", "export") and src.tokens[i + 1].kind == "string" if i + 1 < stop else False:
                end = src.find(i, stop, ";")
                as_at = src.find(i, end, "as")
                uri = self.text(i + 1, i + 2)[1:-1]
                out.imported(f"{t}:{uri}", self.text(as_at + 1, as_at + 2) if as_at < end else None, src.position(src.tokens[i].start)[0])
                i = end + 1
            elif t in ("library", "part"):
                i = src.find(i, stop, ";") + 1
            elif t == "typedef":
                end = min(src.find(i, stop, ";"), stop - 1)
                eq = src.find(i, end, "=")
                paren = src.find(i, end, "(")
                at = i + 1 if eq < end else paren - 1
                if src.is_word(at):
                    self.symbol(self.text(at, at + 1), "type_alias", i, end, None, i, signature=self.text(i, end + 1))
                    self.words(at + 1, end)
                i = end + 1
            else:
                k = i
                while src.at(k) in ("abstract", "base", "sealed", "interface", "final") and src.at(k + 1) in ("class", "abstract", "base", "sealed", "interface", "final", "mixin"):
                    k += 1
                if src.at(k) == "mixin" and src.at(k + 1) == "class":
                    k += 1
                if src.at(k) in ("class", "mixin", "enum", "extension") and src.find(k, stop, "{", ";") < stop and (src.is_word(k + 1)):
                    i = self.container(i, k, stop)
                else:
                    i = self.declaration(i, stop)

    def symbol(self, name: str, kind: str, a: int, b: int, owner: str | None, doc_at: int, signature: str | None = None) -> str:
        """Tokens a to b; members are named by the owner's short name."""
        qname = joined(self.module, joined(self.module, None, owner.rsplit("::", 1)[-1]) if owner else None, name)
        self.out.symbol(self.src, qname, name, kind, self.src.tokens[a].start, self.src.tokens[b].stop, owner, signature if signature is not None else self.text(a, b + 1), None, self.doc(doc_at))
        return qname

    def container(self, i: int, k: int, stop: int) -> int:
        src = self.src
        open_at = src.find(k, stop, "{", ";")
        close = src.partner[open_at] if src.at(open_at) == "{" else open_at
        word = src.at(k)
        name = self.text(k + 1, k + 2)
        if word == "extension":
            if name == "type":
                name = self.text(k + 2, k + 3)
            on = src.find(k + 1, open_at, "on")
            if name == "on" and on == k + 1:
                name = f"extension_on_{self.text(on + 1, on + 2)}"
            qname = self.symbol(name, "extension", i, close, None, i)
        else:
            qname = self.symbol(name, word, i, close, None, i)
        relation, h = None, k + 2
        while h < open_at and word != "extension":
            if src.at(h) in ("extends", "with", "implements", "on"):
                relation = "extends" if src.at(h) == "extends" else "implements"
                if src.at(h) == "on":
                    relation = None
                h += 1
            elif src.is_word(h):
                last = h
                while src.at(last + 1) == "." and last + 2 < open_at:
                    last += 2
                if relation:
                    self.out.relation(qname, relation, self.text(last, last + 1), src.position(src.tokens[h].start)[0])
                h = max(src.skip_angles(last + 1, open_at), last + 1)
            else:
                h = max(src.skip_angles(h, open_at), h + 1)
        at = open_at + 1
        if word == "enum":
            at = self.constants(at, close, qname)
        while at < close:
            at = self.declaration(at, close, qname)
        return close + 1

    def constants(self, i: int, close: int, owner: str) -> int:
        src = self.src
        while i < close and src.at(i) != ";":
            if src.at(i) == ",":
                i += 1
                continue
            if src.at(i) == "@":
                i = src.after(i + 2) if src.at(i + 2) == "(" else i + 2
                continue
            if not src.is_word(i):
                return i + 1
            end = src.skip_angles(i + 1, close)
            if src.at(end) == "(":
                end = src.after(end)
            self.symbol(self.text(i, i + 1), "enum_constant", i, end - 1, owner, i)
            i = end
        return i + 1

    def declaration(self, i: int, stop: int, owner: str | None = None) -> int:
        src = self.src
        while src.at(i) == "@" and i < stop:
            i += 2
            while src.at(i) == ".":
                i += 2
            if src.at(i) == "(":
                i = src.after(i)
        if i >= stop or src.at(i) in (";", "}"):
            return i + 1
        first = i
        k, words = i, set()
        while src.at(k) in _MODIFIERS | {"factory"} and (src.is_word(k + 1) or src.at(k + 1) in ("(",)):
            words.add(src.at(k))
            k += 1
        short = owner.rsplit("::", 1)[-1] if owner else None
        # where the name of what is declared stands
        end = k
        while end < stop and src.at(end) not in ("(", ";", "=", "{", "=>", ","):
            if src.at(end) == "operator" and owner:
                op = end + 1
                while op < stop and src.at(op) != "(" or op == end + 1 and src.at(op) == "(":
                    op += 1
                return self.callable(first, k, end, op, stop, owner, "operator", self.text(end + 1, op))
            if src.at(end) == "get" and src.is_word(end + 1):
                return self.callable(first, k, end + 1, None, stop, owner, "getter" if owner else "function", self.text(end + 1, end + 2))
            if src.at(end) == "set" and src.is_word(end + 1) and src.at(end + 2) == "(":
                return self.callable(first, k, end + 1, end + 2, stop, owner, "setter" if owner else "function", self.text(end + 1, end + 2))
            if src.at(end) == "<":
                end = max(src.skip_angles(end, stop), end + 1)
            elif src.at(end) == "[":
                end = src.after(end)
            else:
                end += 1
            if src.at(end) == "(" and (src.at(end - 1) == "Function" or not src.is_word(end - 1) and src.at(end - 1) != ">"):
                end = src.after(end)
        if end >= stop:
            return stop
        name_at = end - 1
        if src.at(end) == "(":
            if src.at(name_at) == ">":
                name_at = max((x for x in range(k, end) if src.is_word(x) and src.skip_angles(x + 1, end) == end), default=name_at)
            a = name_at - 2 if src.at(name_at - 1) == "." else name_at
            if short and src.at(a) == short:
                name = self.text(name_at, name_at + 1)
                kind = "factory_constructor" if "factory" in words else "const_constructor" if "const" in words else "constructor"
                return self.callable(first, k, name_at, end, stop, owner, kind, name)
            if src.is_word(name_at):
                return self.callable(first, k, name_at, end, stop, owner, "method" if owner else "function", self.text(name_at, name_at + 1))
            return max(src.after(end), i + 1)
        if src.at(end) == "{" or src.at(end) == "=>":
            return max(src.after(end), i + 1)
        finish = min(src.find(end, stop, ";"), stop - 1)
        a = name_at
        while a < finish:
            b = src.find(a, finish, ",")
            if src.is_word(a):
                self.symbol(self.text(a, a + 1), "field" if owner else "variable", first, finish, owner, first)
            a = b + 1
        self.words(k, name_at)
        return finish + 1

    def callable(self, first: int, k: int, name_at: int, params: int | None, stop: int, owner: str | None, kind: str, name: str) -> int:
        """The symbol spans its signature only; calls of the body belong to it."""
        src = self.src
        last = src.partner.get(params, params) if params is not None else name_at
        # what is written before the signature proper, such as static, lies outside of it
        start = k
        if kind in ("factory_constructor", "const_constructor"):
            start = k - 1
        qname = self.symbol(name, kind, start, last, owner, first)
        self.words(start, name_at)
        if params is not None:
            self.words(params + 1, last)
        at = last + 1
        if src.at(at) == ":":
            colon = at
            at = src.find(at, stop, "{", ";", "=>")
            self.inside(colon, min(at, stop), qname)
        while src.at(at) in ("async", "sync", "*", "native") or at < stop and src.tokens[at].kind == "string":
            at += 1
        if src.at(at) == "{" and at < stop:
            self.inside(at + 1, src.partner[at], qname)
            return src.partner[at] + 1
        end = src.find(at, stop, ";")
        if src.at(at) in ("=>", "="):
            self.inside(at + 1, min(end, stop), qname)
        return end + 1

    def words(self, i: int, stop: int) -> None:
        """Names that begin with a capital in a signature are types."""
        for k in range(i, stop):
            t = self.src.tokens[k]
            if t.kind == "word" and t.text.lstrip("_")[:1].isupper() and t.text not in _BUILTIN and self.src.at(k - 1) not in (".", "class"):
                self.out.ref(self.src, self.text(k, k + 1), "type", t.start, t.stop)

    def inside(self, i: int, stop: int, caller: str) -> None:
        src = self.src
        for k in range(i, stop):
            if not src.is_word(k) or src.at(k) in _CONTROL and src.at(k) not in ("super", "this"):
                continue
            called = src.skip_angles(k + 1, stop)
            if src.at(called) != "(" or src.at(k) in ("super", "this"):
                t = src.tokens[k]
                if t.text[:1].isupper() and src.is_word(k + 1) and t.text not in _BUILTIN:
                    self.out.ref(src, self.text(k, k + 1), "type", t.start, t.stop)
                continue
            start = k
            while start > i and src.at(start - 1) in (".", "?.", ".."):
                p = start - 2
                while p >= i and src.at(p) in (")", "]"):
                    p = src.partner.get(p, p) - 1
                if src.at(start - 1) == ".." or p < i or not (src.is_word(p) or src.tokens[p].kind == "string"):
                    start = start if src.at(start - 1) == ".." else max(p + 1, i)
                    break
                start = p
            name = self.text(k, k + 1)
            self.out.call(src, caller, name, src.tokens[start].start)
            self.out.ref(src, name, "call", src.tokens[start].start, src.tokens[src.partner.get(called, called)].stop)
