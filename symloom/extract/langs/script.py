"""TypeScript and JavaScript: functions, classes, interfaces, types, enums, methods, imports."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, utf8
from symloom.extract.record import Found, gathered, joined

PREDEFINED = set("any unknown never void string number boolean symbol object bigint".split())
_CONTROL = set("if for while switch catch return typeof function new await yield delete void in of instanceof do else case throw super import".split())
_MODIFIERS = set("public private protected static readonly abstract override async declare get set accessor".split())


def typescript(body: str, module: str) -> Found:
    return gathered(typescript_pieces(body, module))


def javascript(body: str, module: str) -> Found:
    return gathered(javascript_pieces(body, module))


def typescript_pieces(body: str, module: str) -> Iterator[Found]:
    return _pieces(body, module, "typescript")


def javascript_pieces(body: str, module: str) -> Iterator[Found]:
    return _pieces(body, module, "javascript")


def _pieces(body: str, module: str, language: str) -> Iterator[Found]:
    def walk(src: Source) -> Found:
        out = Found()
        _Walk(src, out, module).statements(0, len(src.tokens))
        return out

    return lexer.pieces(body, language, walk)


class _Walk:
    def __init__(self, src: Source, out: Found, module: str) -> None:
        self.src, self.out, self.module = src, out, module

    def word(self, i: int) -> str:
        t = self.src.tokens[i]
        return self.src.text(t.start, t.stop)

    def end_of_statement(self, i: int, stop: int) -> int:
        """The token that ends the statement at i: its semicolon, or the last one before a line that begins another."""
        src = self.src
        k = i
        while k < stop:
            if src.at(k) == ";":
                return k
            nxt = src.after(k)
            if nxt >= stop:
                return min(nxt, stop) - 1
            last = src.tokens[nxt - 1]
            if src.position(last.stop)[0] < src.position(src.tokens[nxt].start)[0] and last.text not in ("=", "=>", ",", "(", "+", "-", "|", "&", "?", ":", "&&", "||", "extends") and src.at(nxt) not in (".", "?.", "|", "&", "?", ":", "=", "=>", "&&", "||", "+", "-", "(", "{", ")"):
                return nxt - 1
            k = nxt
        return stop - 1

    def statements(self, i: int, stop: int, exported: bool = False) -> None:
        src = self.src
        while i < stop:
            i = self.statement(i, stop, exported)

    def statement(self, i: int, stop: int, exported: bool) -> int:
        src, t = self.src, self.src.at(i)
        if t == "@":
            k = i + 2
            while src.at(k) == ".":
                k += 2
            return src.after(k) if src.at(k) == "(" else k
        if t == "export":
            k = i + 1 + (src.at(i + 1) == "default")
            return self.statement(k, stop, True) if k < stop else stop
        if t == "declare" and src.is_word(i + 1):
            return self.statement(i + 1, stop, exported)
        if t == "import" and src.at(i + 1) not in ("(", "."):
            return self.imports(i, stop)
        is_async = t == "async" and src.at(i + 1) == "function"
        if t == "function" or is_async:
            return self.function(i, i + is_async, stop, exported)
        if t == "class" or t == "abstract" and src.at(i + 1) == "class":
            return self.container(i, i + (t == "abstract"), stop, exported, "class")
        if t == "interface" and src.is_word(i + 1):
            return self.container(i, i, stop, exported, "interface")
        if t == "enum" and src.is_word(i + 1) or t == "const" and src.at(i + 1) == "enum":
            return self.enum(i, i + (t == "const"), stop, exported)
        if t == "type" and src.is_word(i + 1) and src.at(src.skip_angles(i + 2, stop)) == "=":
            end = self.end_of_statement(i, stop)
            name, a, b = self.word(i + 1), src.tokens[i].start, src.tokens[end].stop
            self.out.symbol(src, joined(self.module, None, name), name, "type", a, b, None, src.text(a, b), "export" if exported else None, self.doc(i))
            return end + 1
        if t in ("const", "let", "var") and src.is_word(i + 1):
            return self.variables(i, stop, exported)
        return src.after(i)

    def doc(self, i: int) -> str | None:
        src = self.src
        start, floor = src.tokens[i].start, src.tokens[i - 1].stop if i else 0
        found = [clean(utf8(c.text)) for c in src.comments_before(start, floor)]
        return "\n".join(reversed(found)).strip() if found else None

    def body_at(self, i: int, stop: int) -> int:
        """The brace that opens a body after parameters and a return type, or where the declaration ends without one."""
        src = self.src
        typed = False
        while i < stop:
            t = src.at(i)
            if t == "{" and not typed:
                return i
            if t == ";" or t == "}":
                return i
            if t in (":", "|", "&", "is", "keyof", "=>", "extends"):
                typed = True
                i += 1
                continue
            if t == "<":
                i = max(src.skip_angles(i, stop), i + 1)
            else:
                i = src.after(i)
            typed = False
        return stop

    def function(self, i: int, k: int, stop: int, exported: bool) -> int:
        src = self.src
        n = k + 1 + (src.at(k + 1) == "*")
        if not src.is_word(n):
            return src.after(self.body_at(n, stop))
        name = self.word(n)
        params = src.find(src.skip_angles(n + 1, stop), stop, "(")
        open_at = self.body_at(src.after(params), stop) if params < stop else stop
        if src.at(open_at) != "{":
            return open_at + 1  # an overload's signature is no declaration
        close = src.partner[open_at]
        qname = joined(self.module, None, name)
        a = src.tokens[i].start
        self.out.symbol(src, qname, name, "function", a, src.tokens[close].stop, None, src.text(a, src.tokens[open_at].start).strip(), "export" if exported else None, self.doc(i))
        self.annotations(params + 1, src.partner[params])
        self.type_words(src.partner[params] + 1, open_at)
        self.inside(open_at + 1, close, qname)
        return close + 1

    def container(self, i: int, k: int, stop: int, exported: bool, kind: str) -> int:
        src = self.src
        if not src.is_word(k + 1) or src.at(k + 1) == "extends":
            return src.after(src.find(k + 1, stop, "{"))
        name = self.word(k + 1)
        open_at = src.find(k + 2, stop, "{")
        if open_at >= stop:
            return k + 2
        close, a = src.partner[open_at], src.tokens[i].start
        qname = joined(self.module, None, name)
        self.out.symbol(src, qname, name, kind, a, src.tokens[close].stop, None, src.text(a, src.tokens[open_at].start).strip(), "export" if exported else None, self.doc(i))
        relation, h = None, src.skip_angles(k + 2, open_at)
        while h < open_at:
            t = src.at(h)
            if t in ("extends", "implements"):
                relation = t
                h += 1
            elif src.is_word(h) and relation and src.at(h - 1) in (",", "extends", "implements"):
                last = h
                while src.at(last + 1) == "." and src.is_word(last + 2):
                    last += 2
                if src.at(last + 1) != "(":
                    self.out.relation(qname, relation, src.text(src.tokens[h].start, src.tokens[last].stop), src.position(src.tokens[h].start)[0])
                h = max(src.skip_angles(last + 1, open_at), last + 1)
            else:
                h = src.after(h)
        self.members(open_at + 1, close, qname)
        return close + 1

    def enum(self, i: int, k: int, stop: int, exported: bool) -> int:
        src = self.src
        name, open_at = self.word(k + 1), src.find(k + 2, stop, "{")
        if open_at >= stop:
            return k + 2
        a, close = src.tokens[i].start, src.partner[open_at]
        self.out.symbol(src, joined(self.module, None, name), name, "enum", a, src.tokens[close].stop, None, src.text(a, src.tokens[open_at].start).strip(), "export" if exported else None, self.doc(i))
        return close + 1

    def members(self, i: int, stop: int, owner: str) -> None:
        src = self.src
        while i < stop:
            t = src.at(i)
            if t in (";", ","):
                i += 1
                continue
            if t == "@":
                i = self.statement(i, stop, False)
                continue
            k = i
            while src.at(k) in _MODIFIERS and src.at(k + 1) not in ("(", "=", ":", ";", "<", "?", "!", ",", "}"):
                k += 1
            k += src.at(k) == "*"
            if src.at(k) == "{":  # a static block
                i = src.after(k)
                continue
            if src.at(k) == "#":
                k += 1
            n = src.after(k) if src.at(k) == "[" else k + 1
            if src.at(n) in ("?", "!"):
                n += 1
            p = src.skip_angles(n, stop)
            named = src.tokens[k].kind in ("word", "string", "number") if k < stop else False
            name = src.text(src.tokens[k - (src.at(k - 1) == "#")].start, src.tokens[k].stop) if named else src.text(src.tokens[k].start, src.tokens[min(n, stop) - 1].stop)
            if src.at(p) == "(":
                open_at = self.body_at(src.after(p), stop)
                a = src.tokens[i].start
                qname = f"{owner}::{name}"
                if src.at(open_at) == "{" and open_at < stop:
                    close = src.partner[open_at]
                    self.out.symbol(src, qname, name, "method", a, src.tokens[close].stop, owner, src.text(a, src.tokens[open_at].start).strip(), None, self.doc(i))
                    self.inside(open_at + 1, close, qname)
                    i = close + 1
                else:
                    end = min(self.end_of_statement(i, stop), max(open_at, i + 1)) if src.at(open_at) != ";" else open_at
                    end = min(end, stop - 1)
                    last = end - (src.at(end) in (";", ","))
                    self.out.symbol(src, qname, name, "method", a, src.tokens[last].stop, owner, None, None, self.doc(i))
                    i = end + 1
                continue
            end = self.end_of_statement(i, stop)
            eq = src.find(n, end + 1, "=")
            if eq <= end and named and self.function_value(eq + 1, end + 1):
                a, last = src.tokens[i].start, end - (src.at(end) == ";")
                qname = f"{owner}::{name}"
                self.out.symbol(src, qname, name, "method", a, src.tokens[last].stop, owner, src.text(a, src.tokens[last].stop), None, self.doc(i))
                self.value_body(eq + 1, last + 1, qname)
            i = max(end + 1, src.after(i))

    def function_value(self, i: int, stop: int) -> bool:
        src = self.src
        i += src.at(i) == "async"
        if src.at(i) == "function":
            return True
        i = src.skip_angles(i, stop)
        if src.is_word(i) and src.at(i + 1) == "=>":
            return True
        if src.at(i) != "(":
            return False
        k = src.after(i)
        return src.at(k) == "=>" or src.at(k) == ":" and src.find(k, min(stop, k + 60), "=>") < min(stop, k + 60)

    def value_body(self, i: int, stop: int, qname: str) -> int:
        """Walks the body of a function value; gives the place where it begins."""
        src = self.src
        if src.at(i + (src.at(i) == "async")) == "function":
            open_at = src.find(i, stop, "{")
        else:
            open_at = src.find(src.after(src.find(i, stop, "(")) if src.at(i + (src.at(i) == "async")) in ("(", "<") else i, stop, "=>") + 1
        if open_at < stop:
            close = src.partner[open_at] if src.at(open_at) == "{" else stop
            self.inside(open_at, min(close + 1, stop), qname)
        return open_at

    def variables(self, i: int, stop: int, exported: bool) -> int:
        src, end = self.src, self.end_of_statement(i, stop)
        k = i + 1
        while k <= end and src.is_word(k):
            comma = src.find(k, end + 1, ",")
            last = comma - 1 if comma <= end else end - (src.at(end) == ";")
            eq = src.find(k, last + 1, "=")
            if eq <= last and self.function_value(eq + 1, last + 1):
                name, a = self.word(k), src.tokens[k].start
                qname = joined(self.module, None, name)
                at = len(self.out.symbols)
                body_at = self.value_body(eq + 1, last + 1, qname)
                head = src.text(src.tokens[eq + 1].start, src.tokens[body_at].start).strip() if body_at <= last else ""
                self.out.symbol(src, qname, name, "function", a, src.tokens[last].stop, None, f"{name} = {head}", "export" if exported else None, None)
                assert len(self.out.symbols) == at + 1
            k = last + 2
        return end + 1

    def imports(self, i: int, stop: int) -> int:
        src, end = self.src, self.end_of_statement(i, stop)
        strings = [k for k in range(i, end + 1) if src.tokens[k].kind == "string"]
        if not strings:
            return end + 1
        path, line, n = self.word(strings[-1])[1:-1], src.position(src.tokens[i].start)[0], 0
        k = i + 1 + (src.at(i + 1) == "type" and src.at(i + 2) != "from")
        while k < strings[-1] and src.at(k) != "from":
            if src.at(k) == "*" and src.at(k + 1) == "as":
                self.out.imported(path, self.word(k + 2), line)
                k, n = k + 3, n + 1
            elif src.at(k) == "{":
                close, a = src.partner[k], k + 1
                while a < close:
                    b = src.find(a, close, ",")
                    if a < b:
                        self.out.imported(path, self.word(b - 1), line)
                        n += 1
                    a = b + 1
                k = close + 1
            elif src.is_word(k):
                self.out.imported(path, self.word(k), line)
                k, n = k + 1, n + 1
            else:
                k += 1
        if not n:
            self.out.imported(path, None, line)
        return end + 1

    def type_words(self, i: int, stop: int) -> None:
        for k in range(i, stop):
            t = self.src.tokens[k]
            if t.kind == "word" and t.text not in ("extends", "keyof", "typeof", "is", "readonly", "infer", "async", "null", "undefined", "this", "true", "false") and self.src.at(k + 1) not in (":", "?") and self.src.at(k - 1) != ".":
                self.out.ref(self.src, self.word(k), "type", t.start, t.stop)

    def annotations(self, i: int, stop: int) -> None:
        """Types after the colons of parameters."""
        src = self.src
        while i < stop:
            comma = src.find(i, stop, ",")
            colon = src.find(i, comma, ":")
            if colon < comma:
                end = src.find(colon, comma, "=")
                self.type_words(colon + 1, end)
            i = comma + 1

    def inside(self, i: int, stop: int, caller: str) -> None:
        src = self.src
        for k in range(i, stop):
            t = src.tokens[k]
            if t.kind == "word":
                called = k + 1
                if src.at(called) == "?." and src.at(called + 1) == "(":
                    called += 1
                if src.at(called) == "<":
                    past = src.skip_angles(called, stop)
                    if past > called and src.at(past) == "(":
                        self.type_words(called + 1, past - 1)
                        called = past
                if src.at(called) == "(" and (t.text not in _CONTROL or t.text == "super" or src.at(k - 1) in (".", "?.")) and not self.is_new(k, i) and src.at(k - 1) != "function":
                    start = self.chain_start(k, i)
                    name = self.word(k)
                    self.out.call(src, caller, name, src.tokens[start].start)
                    self.out.ref(src, name, "call", src.tokens[start].start, src.tokens[src.partner.get(called, called)].stop)
                elif t.text in ("as", "satisfies") and src.is_word(k + 1) and src.at(k + 1) != "const" and k > i and (src.tokens[k - 1].kind != "op" or src.at(k - 1) in (")", "]", "}")):
                    self.type_words(k + 1, k + 2)
                elif t.text in ("const", "let", "var") and src.is_word(k + 1) and src.at(k + 2) == ":":
                    self.type_words(k + 3, min(src.find(k + 3, stop, "=", ";", "of", "in"), stop))

    def is_new(self, k: int, floor: int) -> bool:
        while k - 2 >= floor and self.src.at(k - 1) == "." and self.src.is_word(k - 2):
            k -= 2
        return self.src.at(k - 1) == "new"

    def chain_start(self, k: int, floor: int) -> int:
        src = self.src
        while k > floor and src.at(k - 1) in (".", "?."):
            p = k - 2
            while p >= floor and src.at(p) in (")", "]"):
                p = src.partner.get(p, p) - 1
            if p < floor or not (src.is_word(p) or src.tokens[p].kind in ("string", "number")):
                return max(p + 1, floor)
            k = p
        return k


def clean(text: str) -> str:
    """A comment without its marks."""
    text = text.strip()
    if text.startswith("//"):
        return text[2:].strip()
    inner = text[2:].lstrip("*")
    inner = inner[:-2] if inner.endswith("*/") else inner
    rows = [r.strip() for r in inner.strip("\n").split("\n")]
    return "\n".join(r[2:] if r.startswith("* ") else r[1:] if r.startswith("*") else r for r in rows).strip()
