"""What extraction collects in a file."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from symloom.extract.lexer import Source


#: Records that go with a symbol of their file, and where its name is.
OWNERS = {"calls": "caller_qualified_name", "types": "owner_qualified_name"}


@dataclass
class Found:
    """Lists of rows as dicts, in the order in which they were met."""

    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)

    def symbol(self, src: Source, qname: str, name: str, kind: str, start: int, stop: int, parent: str | None, signature: str | None = None, visibility: str | None = None, doc: str | None = None) -> None:
        (sl, sc), (el, ec) = src.position(start), src.position(stop)
        self.symbols.append({"qualified_name": qname, "name": name, "kind": kind, "start_line": sl, "start_col": sc, "end_line": el, "end_col": ec, "body_start_byte": start, "body_end_byte": stop, "signature": signature or None, "visibility": visibility, "parent_qualified_name": parent, "doc_comment": doc})

    def ref(self, src: Source, name: str, kind: str, start: int, stop: int) -> None:
        (sl, sc), (el, ec) = src.position(start), src.position(stop)
        self.refs.append({"line": sl, "col": sc, "end_line": el, "end_col": ec, "kind": kind, "raw_name": name})

    def call(self, src: Source, caller: str, callee: str, start: int) -> None:
        line, col = src.position(start)
        self.calls.append({"caller_qualified_name": caller, "callee_raw_name": callee, "line": line, "col": col})

    def imported(self, path: str, alias: str | None, line: int) -> None:
        self.imports.append({"raw_path": path, "alias": alias, "line": line})

    def relation(self, owner: str, relation: str, target: str, line: int) -> None:
        self.types.append({"owner_qualified_name": owner, "relation": relation, "target_raw_name": target, "line": line})

    def without_strangers(self) -> None:
        """Drops calls and relations of owners that are no symbol of the file."""
        own = {s["qualified_name"] for s in self.symbols}
        self.calls = [c for c in self.calls if c["caller_qualified_name"] in own]
        self.types = [t for t in self.types if t["owner_qualified_name"] in own]


def gathered(pieces: Iterable[Found]) -> Found:
    """What the pieces of a file hold together."""
    out = Found()
    for x in pieces:
        for kind, rows in vars(out).items():
            rows += getattr(x, kind)
    out.without_strangers()
    return out


def joined(module: str, parent: str | None, name: str, sep: str = "::") -> str:
    return sep.join(x for x in ((parent,) if parent else (module,)) if x) + (sep if parent or module else "") + name


def stripped(text: str, tail: str = ";") -> str:
    return text.strip().rstrip(tail).strip()
