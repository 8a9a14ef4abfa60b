"""C#: namespaces, types and members."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, utf8
from symloom.extract.record import Found, gathered, joined, stripped

_MODIFIERS = set("public private protected internal static readonly sealed abstract virtual override async extern unsafe new partial volatile const required file ref".split())
_TYPES = {"class": "class", "struct": "struct", "interface": "interface", "record": "class"}
_CONTROL = set("if for foreach while switch catch return throw lock using fixed else do try case base this typeof sizeof nameof default checked unchecked when await new out ref in is as var".split())
_PREDEFINED = set("int long short byte sbyte uint ulong ushort float double decimal bool char string object void dynamic var nint nuint".split())


def extract(body: str, module: str) -> Found:
    return gathered(pieces(body, module))


def pieces(body: str, module: str) -> Iterator[Found]:
    named = None

    def walk(src: Source) -> Found:
        nonlocal named
        out = Found()
        walk, n = _Walk(src, out), len(src.tokens)
        if not src.begin:
            k = next((i for i in range(n) if src.at(i) == "namespace"), None)
            named = "::".join(x.strip() for x in walk.text(k + 1, src.find(k, n, "{", ";")).split(".")) if k is not None else None
        if named is None and body.find("namespace", src.end) >= 0:
            src.past = True  # it may be named later
        walk.module = named or ""
        walk.declarations(0, n, None)
        return out

    return lexer.pieces(body, "csharp", walk)


class _Walk:
    def __init__(self, src: Source, out: Found) -> None:
        self.src, self.out, self.module = src, out, ""

    def text(self, a: int, b: int) -> str:
        return self.src.span(a, b)

    def doc(self, i: int) -> str | None:
        src, out = self.src, []
        for c in src.comments_before(src.tokens[i].start, src.tokens[i - 1].stop if i else 0):
            text = utf8(c.text)
            if text.startswith("///"):
                out.append(text[3:].strip())
            elif text.startswith("/*"):
                out.append(text[2:].lstrip("*").removesuffix("*/").strip())
            else:
                break
        return "\n".join(reversed(out)).strip() or None

    def head(self, i: int, stop: int) -> tuple[int, str]:
        """Past attributes and modifiers; the modifiers joined, or default."""
        src, mods = self.src, []
        while i < stop:
            if src.at(i) == "[":
                i = src.after(i)
            elif src.at(i) in _MODIFIERS and not (src.at(i) == "ref" and src.at(i + 1) == "("):
                mods.append(src.at(i))
                i += 1
            else:
                break
        return i, " ".join(mods) or "default"

    def signature(self, a: int, b: int) -> str:
        return stripped(self.text(a, b))

    def declarations(self, i: int, stop: int, parent: str | None) -> None:
        src, out = self.src, self.out
        while i < stop:
            t = src.at(i)
            if t in (";", ","):
                i += 1
                continue
            if t == "namespace":
                end = src.find(i, stop, "{", ";")
                if src.at(end) == "{" and end < stop:
                    self.declarations(end + 1, src.partner[end], parent)
                    i = src.after(end)
                else:
                    i = end + 1
                continue
            if t in ("using", "global") and parent is None:
                i = self.using(i, stop)
                continue
            k, vis = self.head(i, stop)
            if k >= stop:
                return
            t = src.at(k)
            if t in _TYPES and src.is_word(k + 1 + (t == "record" and src.at(k + 1) in ("class", "struct"))):
                i = self.type(i, k, stop, parent, vis)
            elif t == "enum" and src.is_word(k + 1):
                i = self.enum(i, k, stop, parent, vis)
            elif t == "delegate":
                i = self.delegate(i, k, stop, parent, vis)
            elif t == "event":
                i = self.field(i, k + 1, stop, parent, vis, "event")
            elif parent is None or t in ("}", "{") or t == "~":
                i = max(src.after(src.find(k, stop, "{", ";")) if t == "~" else src.after(k), i + 1)
            else:
                i = self.member(i, k, stop, parent, vis)

    def using(self, i: int, stop: int) -> int:
        src, end = self.src, self.src.find(i, stop, ";")
        k = i + 1
        while src.at(k) in ("using", "static", "unsafe"):
            k += 1
        if src.at(k) == "(":
            return src.after(k)
        eq = src.find(k, end, "=")
        alias = self.text(k, eq) if eq < end else None
        path = self.text(eq + 1 if eq < end else k, end)
        if path:
            self.out.imported(path, alias, src.position(src.tokens[i].start)[0])
        return end + 1

    def type(self, i: int, k: int, stop: int, parent: str | None, vis: str) -> int:
        src, out = self.src, self.out
        kind = _TYPES[src.at(k)]
        if src.at(k) == "record" and src.at(k + 1) in ("class", "struct"):
            kind, k = src.at(k + 1), k + 1
        name, open_at = self.text(k + 1, k + 2), src.find(k + 2, stop, "{", ";")
        close = src.partner[open_at] if src.at(open_at) == "{" and open_at < stop else min(open_at, stop - 1)
        qname = joined(self.module, parent, name)
        out.symbol(src, qname, name, kind, src.tokens[i].start, src.tokens[close].stop, parent, self.signature(i, min(open_at, stop)), vis, self.doc(i))
        h = src.skip_angles(k + 2, open_at)
        self.words(k + 3, h - 1)
        if src.at(h) == "(":
            h = src.after(h)
        if src.at(h) == ":":
            limit = src.find(h, open_at, "where")
            a = h + 1
            while a < limit:
                last = a
                while src.at(last + 1) == "." and last + 2 < limit:
                    last += 2
                if src.is_word(a):
                    self.out.relation(qname, "extends", self.text(a, last + 1), src.position(src.tokens[a].start)[0])
                a = src.skip_angles(last + 1, limit)
                a = src.find(a, limit, ",") + 1
        if src.at(open_at) == "{" and open_at < stop:
            self.declarations(open_at + 1, close, qname)
        return close + 1

    def enum(self, i: int, k: int, stop: int, parent: str | None, vis: str) -> int:
        src = self.src
        name, open_at = self.text(k + 1, k + 2), src.find(k + 2, stop, "{")
        if open_at >= stop:
            return k + 2
        close, qname = src.partner[open_at], joined(self.module, parent, name)
        self.out.symbol(src, qname, name, "enum", src.tokens[i].start, src.tokens[close].stop, parent, self.signature(i, open_at), vis, self.doc(i))
        a = open_at + 1
        while a < close:
            b = src.find(a, close, ",")
            m, _ = self.head(a, b)
            if m < b and src.is_word(m):
                one = self.text(m, m + 1)
                self.out.symbol(src, f"{qname}::{one}", one, "enum_member", src.tokens[a].start, src.tokens[b - 1].stop, qname, None, None, self.doc(a))
            a = b + 1
        return close + 1

    def delegate(self, i: int, k: int, stop: int, parent: str | None, vis: str) -> int:
        src = self.src
        params, end = src.find(k, stop, "("), src.find(k, stop, ";")
        name_at = params - 1
        if src.at(name_at) == ">":
            name_at = max(x for x in range(k, params) if src.is_word(x) and src.skip_angles(x + 1, params) == params)
        end = min(end, stop - 1)
        name = self.text(name_at, name_at + 1)
        self.out.symbol(src, joined(self.module, parent, name), name, "delegate", src.tokens[i].start, src.tokens[end].stop, parent, self.signature(i, end + 1), vis, self.doc(i))
        self.words(params + 1, src.partner.get(params, params))
        self.words(k + 1, name_at)
        return end + 1

    def words(self, i: int, stop: int) -> None:
        """The names of a region as references to types, as parameters, fields and properties are read: a generic or dotted name is one, a call
        or a new object none; after = dots are members."""
        src, k, value = self.src, i, False
        while k < stop:
            if src.at(k) in ("=", "=>"):
                value = True
            elif src.at(k) in (",", ";"):
                value = False
            elif src.at(k) == "new":
                k = self.type_end(k + 1, stop)
                while src.at(k) in ("(", "{", "[") and k < stop:
                    k = src.after(k)
                continue
            elif src.is_word(k) and src.at(k) not in _MODIFIERS | _CONTROL - {"var"} | {"params", "get", "set", "init", "add", "remove", "where", "null", "true", "false", "value", "this"}:
                end = self.type_end(k, stop) if not value else k + 1
                if value and src.at(k + 1) == "<" and (past := src.skip_angles(k + 1, stop)) > k + 1 and src.at(past) in ("(", ".", ")", ",", ";"):
                    end = past
                if value and src.at(end) == "(" and end < stop:
                    k = src.after(end)
                    continue
                last = end
                while not value and src.at(last - 1) in ("]", "?") and last - 1 > k:  # arrays and nullables are written around the name
                    last = src.partner.get(last - 1, last - 1)
                self.out.ref(src, self.text(k, last), "type", src.tokens[k].start, src.tokens[last - 1].stop)
                k = end
                continue
            k += 1

    def type_end(self, i: int, stop: int) -> int:
        """Past the type that begins at i: a name with its path and arguments, or a tuple, and what follows for arrays and nullables."""
        src = self.src
        if src.at(i) == "(":
            k = src.after(i)
        else:
            k = i + 1
            while k < stop:
                if src.at(k) in (".", "::") and src.is_word(k + 1):
                    k += 2
                elif src.at(k) == "<" and (past := src.skip_angles(k, stop)) > k:
                    k = past
                else:
                    break
        while k < stop and (src.at(k) in ("?", "*") or src.at(k) == "[" and set(src.at(x) for x in range(k + 1, src.partner[k])) <= {","}):
            k = src.after(k)
        return min(k, stop)

    def member(self, i: int, k: int, stop: int, parent: str, vis: str) -> int:
        src = self.src
        short = parent.rsplit("::", 1)[-1]
        if src.at(k) == short and src.at(k + 1) == "(":
            return self.callable(i, k, k, stop, parent, vis, "constructor")
        name_at = self.type_end(k, stop)
        if src.at(name_at) == "(" and name_at < stop and name_at - 1 > k and src.is_word(name_at - 1) and not src.is_word(name_at):
            return max(src.after(src.find(name_at, stop, "{", ";")), i + 1)  # a conversion or an operator
        if name_at < stop and src.is_word(name_at):
            while src.at(name_at + 1) in (".", "::") and src.is_word(name_at + 2):  # a member of an interface by its full name
                name_at += 2
            at = src.skip_angles(name_at + 1, stop)
            if src.at(at) == ".":
                while src.at(at) == "." and src.is_word(at + 1):
                    name_at, at = at + 1, src.skip_angles(at + 2, stop)
            end = at
        else:
            end = src.find(k, stop, ";", "{", "=", "(", "=>", ",")
        if end >= stop:
            return stop
        t = src.at(end)
        if name_at >= stop or not src.is_word(name_at) or name_at <= k:
            return max(src.after(end), i + 1)
        if t == "(":
            return self.callable(i, name_at, k, stop, parent, vis, "method")
        if t in ("{", "=>"):
            name = self.text(name_at, name_at + 1)
            close = src.partner[end] if t == "{" else min(src.find(end, stop, ";"), stop - 1)
            if t == "{" and src.at(close + 1) == "=":
                close = min(src.find(close, stop, ";"), stop - 1)
            self.out.symbol(src, joined(self.module, parent, name), name, "property", src.tokens[i].start, src.tokens[close].stop, parent, self.signature(i, end), vis, self.doc(i))
            self.words(k, close)
            return close + 1
        return self.field(i, k, stop, parent, vis, "field")

    def field(self, i: int, k: int, stop: int, parent: str, vis: str, kind: str) -> int:
        src = self.src
        end = min(src.find(k, stop, ";", "{"), stop - 1)
        if src.at(end) == "{":
            end = src.partner[end]
        names, a = [], self.type_end(k, end)
        while a < end:
            if src.is_word(a) and src.at(a + 1) in ("=", ",", ";", "{", "[") or src.is_word(a) and a + 1 >= end:
                names.append(self.text(a, a + 1))
            while a < end and src.at(a) != ",":
                past = src.skip_angles(a, end)
                a = past if past > a and src.at(past) in ("(", "[", "{", ".", ")", ",", ";") and src.is_word(a - 1) else src.after(a)
            a += 1
        for name in names:
            self.out.symbol(src, joined(self.module, parent, name), name, kind, src.tokens[i].start, src.tokens[end].stop, parent, None, vis, self.doc(i))
        self.words(k, end)
        return end + 1

    def callable(self, i: int, name_at: int, type_at: int, stop: int, parent: str, vis: str, kind: str) -> int:
        src = self.src
        params = src.find(name_at, stop, "(")
        end = src.find(src.after(params), stop, "{", ";", "=>")
        name = self.text(name_at, name_at + 1)
        qname = joined(self.module, parent, name)
        if src.at(end) == "{" and end < stop:
            close, body = src.partner[end], (end + 1, src.partner[end])
        else:
            close = min(src.find(end, stop, ";"), stop - 1)
            body = (end + 1, close) if src.at(end) == "=>" else None
        self.out.symbol(src, qname, name, kind, src.tokens[i].start, src.tokens[close].stop, parent, self.signature(i, end if body else close + 1), vis, self.doc(i))
        self.words(params + 1, src.partner.get(params, params))
        if kind == "method":
            self.words(type_at, name_at)
        if body:
            self.inside(*body, qname)
        return close + 1

    def inside(self, i: int, stop: int, caller: str) -> None:
        src = self.src
        for k in range(i, stop):
            if src.at(k) == "new" and src.is_word(k + 1):
                last = k + 1
                while src.at(last + 1) == "." and src.is_word(last + 2):
                    last += 2
                past = src.skip_angles(last + 1, stop)
                if src.at(past) in ("(", "{"):
                    self.out.call(src, caller, self.text(k + 1, past), src.tokens[k].start)
                    t = src.tokens[last]
                    self.out.ref(src, self.text(last, last + 1), "type", t.start, t.stop)
            elif src.is_word(k) and src.at(k) not in _CONTROL:
                called = src.skip_angles(k + 1, stop)
                if src.at(called) != "(":
                    if src.is_word(k + 1) and src.at(k)[0].isupper() and src.at(k + 2) in ("=", ";", "in"):
                        t = src.tokens[k]
                        self.out.ref(src, self.text(k, k + 1), "type", t.start, t.stop)
                    continue
                start = k
                while start > i and src.at(start - 1) in (".", "?.", "::"):
                    p = start - 2
                    while p >= i and src.at(p) in (")", "]"):
                        p = src.partner.get(p, p) - 1
                    if p < i or not (src.is_word(p) or src.tokens[p].kind == "string"):
                        start = max(p + 1, i)
                        break
                    start = p
                if src.at(start - 1) == "new":
                    continue
                name = self.text(k, k + 1)
                self.out.call(src, caller, name, src.tokens[start].start)
                self.out.ref(src, name, "call", src.tokens[start].start, src.tokens[src.partner.get(called, called)].stop)
