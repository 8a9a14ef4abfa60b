"""Rust: items, methods by type and trait, uses."""

from __future__ import annotations

from collections.abc import Iterator

from symloom.extract import lexer
from symloom.extract.lexer import Source, Token
from symloom.extract.record import Found, gathered, joined, stripped

PRIMITIVES = set("bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())
KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield".split()
)
_ITEM = {"fn", "struct", "enum", "trait", "impl", "mod", "const", "static", "type", "use", "union"}
_BEFORE = {"pub", "async", "unsafe", "extern", "default", "const"}


def extract(body: str, module: str) -> Found:
    return gathered(pieces(body, module))


def pieces(body: str, module: str) -> Iterator[Found]:
    def walk(src: Source) -> Found:
        out = Found()
        _Walk(src, out, module).items(0, len(src.tokens), None, "file")
        return out

    return lexer.pieces(body, "rust", walk)


class _Walk:
    def __init__(self, src: Source, out: Found, module: str) -> None:
        self.src, self.out, self.module = src, out, module

    def items(self, i: int, stop: int, parent: str | None, scope: str) -> None:
        src = self.src
        while i < stop:
            t = src.at(i)
            if t == "#":  # an attribute is no part of its item
                i = src.after(i + 1 + (src.at(i + 1) == "!"))
                continue
            k, begin, visibility = i, i, None
            if src.at(k) == "pub":
                k += 1
                if src.at(k) == "(":
                    k = src.after(k)
                visibility = src.text(src.tokens[i].start, src.tokens[k - 1].stop)
            while src.at(k) in _BEFORE and src.at(k) != "pub" or k < stop and src.tokens[k].kind == "string" and src.at(k - 1) == "extern":
                if src.at(k) == "const" and src.at(k + 1) not in ("fn", "unsafe", "async", "extern"):
                    break
                k += 1
            word = src.at(k)
            if word == "macro_rules" and src.at(k + 1) == "!":
                i = src.after(src.find(k, stop, "{", "(", "["))
            elif word == "{" and src.at(k - 1) in ("extern",) or word == "{" and k > i and src.tokens[k - 1].kind == "string":
                i = src.after(k)
            elif word in _ITEM and src.tokens[k].kind == "word":
                i = self.item(word, begin, k, stop, parent, scope, visibility)
            else:
                i = src.after(i)

    def item(self, word: str, begin: int, k: int, stop: int, parent: str | None, scope: str, visibility: str | None) -> int:
        src, out = self.src, self.out
        start = src.tokens[begin].start
        if word == "use":
            end = src.find(k, stop, ";")
            self.use(k + 1, end, "", src.position(start)[0])
            return end + 1
        if word == "impl":
            return self.impl(k, stop, parent)
        name_at = k + 1 + (src.at(k + 1) == "mut")
        if not src.is_word(name_at):
            return k + 1
        name = src.text(src.tokens[name_at].start, src.tokens[name_at].stop)
        qname = joined(self.module, parent, name)
        body_at = src.find(src.skip_angles(name_at + 1, stop), stop, "{", ";", "=") if word in ("type", "const", "static") else self.body(name_at + 1, stop)
        if word in ("type", "const", "static"):
            end_at = src.find(name_at, stop, ";")
            signature_to = None
        else:
            end_at = src.partner.get(body_at, body_at) if src.at(body_at) == "{" else min(src.find(body_at, stop, ";"), stop - 1)
            signature_to = src.tokens[body_at].start if src.at(body_at) == "{" else None
        end_at = min(end_at, stop - 1)
        tuple_at = None
        if word in ("struct", "union"):
            first = src.skip_angles(name_at + 1, stop)
            if src.at(first) == "(":
                tuple_at, end_at, signature_to = first, min(src.find(first, stop, ";"), stop - 1), src.tokens[first].start
        finish = src.tokens[end_at].stop
        kind = {"fn": "function", "struct": "struct", "union": "union", "enum": "enum", "trait": "trait", "mod": "module", "const": "const", "static": "static", "type": "type"}[word]
        if word == "fn" and scope == "impl":
            kind = "method"
        elif word == "fn" and scope == "trait" and src.at(end_at) == ";":
            kind = "trait_method"
        elif word == "type" and scope == "trait":
            kind = "associated_type"
        if word == "union":
            return end_at + 1
        signature = stripped(src.text(start, signature_to if signature_to is not None else finish))
        out.symbol(src, qname, name, kind, start, finish, parent, signature, visibility, self.doc(start, begin))
        if word == "fn":
            self.inside(begin, end_at + 1, qname)
        elif word == "struct":
            if tuple_at is not None:
                self.tuple_fields(tuple_at, qname)
            elif src.at(body_at) == "{":
                self.fields(body_at, qname)
        elif word == "trait" and src.at(body_at) == "{":
            self.items(body_at + 1, end_at, qname, "trait")
        elif word == "mod" and src.at(body_at) == "{":
            self.items(body_at + 1, end_at, qname, "module")
        return end_at + 1

    def body(self, i: int, stop: int) -> int:
        src = self.src
        while i < stop and src.at(i) not in ("{", ";"):
            i = src.after(i) if src.at(i) in ("(", "[") else i + 1
        return i

    def impl(self, k: int, stop: int, parent: str | None) -> int:
        src, out = self.src, self.out
        first = src.skip_angles(k + 1, stop)
        open_at = self.body(first, stop)
        for_at = src.find(first, open_at, "for")
        where = src.find(first, open_at, "where")
        trait = None
        if for_at < where:
            trait = self.bare(first, for_at)
            first = for_at + 1
        type_qname = joined(self.module, parent, self.bare(first, where))
        inner = type_qname
        if trait is not None:
            out.relation(type_qname, "implements", trait, src.position(src.tokens[k].start)[0])
            inner += "::" + trait.rsplit("::", 1)[-1] if trait else ""
        if src.at(open_at) != "{":
            return open_at + 1
        close = src.partner.get(open_at, stop)
        self.items(open_at + 1, close, inner, "impl")
        return close + 1

    def bare(self, i: int, stop: int) -> str:
        if i >= stop:
            return ""
        return self.src.text(self.src.tokens[i].start, self.src.tokens[stop - 1].stop).split("<", 1)[0].strip()

    def split(self, i: int, stop: int) -> list[tuple[int, int]]:
        """Ranges between commas outside brackets and angles."""
        src, out, a = self.src, [], i
        while i < stop:
            if src.at(i) == ",":
                out.append((a, i))
                i += 1
                a = i
            elif src.at(i) == "<":
                i = max(src.skip_angles(i, stop), i + 1)
            else:
                i = src.after(i)
        return [(x, y) for x, y in [*out, (a, stop)] if x < y]

    def fields(self, open_at: int, owner: str) -> None:
        src = self.src
        for a, b in self.split(open_at + 1, src.partner[open_at]):
            while src.at(a) == "#":
                a = src.after(a + 1)
            colon = src.find(a, b, ":")
            if colon + 1 < b:
                self.out.relation(owner, "field_type", src.text(src.tokens[colon + 1].start, src.tokens[b - 1].stop).strip(), src.position(src.tokens[a].start)[0])

    def tuple_fields(self, open_at: int, owner: str) -> None:
        src = self.src
        for a, b in self.split(open_at + 1, src.partner[open_at]):
            while src.at(a) == "#":
                a = src.after(a + 1)
            if src.at(a) == "pub":
                a = a + 1 if src.at(a + 1) != "(" else src.after(a + 1)
            if a < b:
                self.out.relation(owner, "field_type", src.text(src.tokens[a].start, src.tokens[b - 1].stop).strip(), src.position(src.tokens[a].start)[0])

    def inside(self, i: int, stop: int, caller: str) -> None:
        """Calls, and names that stand where a type can. What a macro is given are tokens, neither calls nor types."""
        src, k = self.src, i - 1
        body = next((x for x in range(i, stop) if src.at(x) == "{"), stop)
        while (k := k + 1) < stop:
            t = src.tokens[k]
            if t.kind != "word":
                continue
            if src.at(k + 1) == "!" and src.at(k + 2) in ("(", "[", "{"):
                k = src.after(k + 2) - 1
                continue
            called = k + 1
            if src.at(k + 1) == "::" and src.at(k + 2) == "<":
                called = src.skip_angles(k + 2, stop)
            if src.at(called) == "(" and t.text not in KEYWORDS - {"self", "Self", "super", "crate"} and src.at(k - 1) not in ("fn", "!"):
                a = self.callee_start(k, i)
                self.out.call(src, caller, src.text(src.tokens[a].start, src.tokens[called - 1].stop), src.tokens[a].start)
            if t.text not in KEYWORDS and t.text not in PRIMITIVES and self.in_type(k) and (t.text[0].isupper() or self.after_type_mark(k, k < body)):
                self.out.ref(src, src.text(t.start, t.stop), "type", t.start, t.stop)

    def after_type_mark(self, k: int, header: bool) -> bool:
        """Whether a type must stand here whatever its name looks like: after ->, as or dyn, after the colon of a parameter or a let."""
        src, p = self.src, k - 1
        while src.at(p) in ("&", "mut", "*", "const", "[", "&&") or 0 <= p and src.tokens[p].kind == "lifetime":
            p -= 1
        if src.at(p) in ("->", "as", "dyn"):
            return True
        if src.at(p) == "<":  # an argument of a generic type that stands in such a place
            return src.is_word(p - 1) and (src.at(p - 1)[0].isupper() or self.after_type_mark(p - 1, header)) and src.skip_angles(p, len(src.tokens)) > p
        if src.at(p) != ":":
            return False
        return header or src.at(p - 2) == "let" or src.at(p - 2) == "mut" and src.at(p - 3) == "let"

    def callee_start(self, k: int, floor: int) -> int:
        """Back over a path or a chain of members to where the callee's text begins."""
        src = self.src
        while k > floor:
            before = src.at(k - 1)
            if before in ("::", ".", "?."):
                k -= 1
                p = k - 1
                while src.at(p) in ("?", "??"):
                    p -= 1
                while src.at(p) in (")", "]"):
                    p = src.partner.get(p, p) - 1
                if src.at(p) == ">":
                    depth, q = 0, p
                    while q > floor:
                        depth += (src.at(q) == ">") - (src.at(q) == "<")
                        if depth == 0:
                            break
                        q -= 1
                    p = q - 1 if src.at(q - 1) != "::" else q - 2
                    if not src.is_word(p):
                        return q
                if not (src.is_word(p) or 0 <= p and src.tokens[p].kind in ("string", "number")) or src.at(p) in KEYWORDS - {"self", "Self", "super", "crate"}:
                    return p + 1
                k = p
            else:
                break
        return k

    def in_type(self, k: int) -> bool:
        src = self.src
        if src.at(k + 1) in ("(",) or src.at(k + 1) == "!" and src.at(k + 2) in ("(", "[", "{"):
            return False
        return not (src.at(k - 1) in ("fn", ".") or src.at(k + 1) == "::" and src.at(k + 2) != "<")

    def doc(self, start: int, begin: int) -> str | None:
        return doc_comment(self.src, start, begin)

    def use(self, i: int, stop: int, prefix: str, line: int) -> None:
        src = self.src
        add = lambda path: f"{prefix}::{path}" if prefix else path
        for a, b in self.split(i, stop):
            brace = src.find(a, b, "{")
            if brace < b:
                path = src.text(src.tokens[a].start, src.tokens[brace - 1].start) if brace > a else ""
                self.use(brace + 1, src.partner[brace], add(path) if path else prefix, line)
                continue
            as_at = src.find(a, b, "as")
            path = src.text(src.tokens[a].start, src.tokens[as_at - 1].stop)
            alias = src.text(src.tokens[as_at + 1].start, src.tokens[b - 1].stop) if as_at + 1 < b else None
            if path:
                self.out.imported(add(path), alias, line)


def doc_comment(src: Source, start: int, begin: int) -> str | None:
    """Documentation comments right before an item; an attribute or other comment between ends them."""
    floor = src.tokens[begin - 1].stop if begin else 0
    lines = []
    for c in src.comments_before(start, floor):
        one = _doc_line(c)
        if one is None:
            break
        lines.append(one)
    return "\n".join(reversed(lines)) if lines else None


def _doc_line(c: Token) -> str | None:
    from symloom.extract.lexer import utf8

    text = utf8(c.text)
    if text.startswith(("///", "//!")):
        return text[3:].strip()
    if text.startswith(("/**", "/*!")):
        inner = text[3:]
        return (inner[:-2] if inner.endswith("*/") else inner).strip()
    return None
