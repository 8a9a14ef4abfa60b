"""Tokens of brace languages, forgiving whatever is wrong with a text.

Sources are bytes read as Latin-1, so places are byte offsets and every file can be read; text() gives UTF-8 back.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_WORD = r"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"
_NUMBER = r"[0-9](?:[0-9A-Za-z_]|\.(?=[0-9]))*"
_OPS = r"=>|->|::|\.\.\.|\.\.=|\.\.|\?\.|\?\?|&&|\|\||==|!=|<=|>=|:=|<-|\+\+|--|."
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

STRINGS = {
    "rust": r'b?r(?P<h>#*)".*?"(?P=h)|[bc]?"(?:\\.|[^"\\])*"|b?\'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\'\\\n])\'(?!\w)',
    "typescript": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "javascript": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.[^\'\n]*|[^\'\\\n]{1,4})\'',
    "java": r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\[^\'\n]*|[^\'\\\n]{1,4})\'',
    "csharp": r'\$*""".*?"""|(?:\$@|@\$|@)"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\[^\'\n]*|[^\'\\\n]{1,4})\'',
    "dart": r"r?'''.*?'''|r?\"\"\".*?\"\"\"|r\"[^\"\n]*\"|r'[^'\n]*'|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
#: Tokens that a piece of a file has at least, and what the line after it begins with.
PIECE = 50_000
_DECLARED = {
    "rust": "use|pub|fn|struct|enum|trait|impl|mod", "typescript": "import|export|class|abstract|interface|enum|function", "javascript": "import|export|class|function",
    "go": "import|func|type|var|const", "java": "import|public|class|interface|enum|final|abstract", "csharp": "using|namespace|public|internal|class|struct|interface|enum|static|abstract",
    "dart": "import|export|class|abstract|mixin|enum|extension",
}
_REGEX_BEFORE = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "+", "==", "!="}


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, comment, op
    text: str
    start: int
    stop: int


@dataclass
class Source:
    """A text's tokens without comments, the comments, and for each bracket its partner; of the whole text, or of a piece of it from begin to end.

    A piece of most tokens or more ends where a bracket closes the last open one and the next line declares something. past tells that
    it can't be read alone: a bracket is open at its end, or what comes after its end was asked for.
    """

    body: str
    language: str
    begin: int = 0
    most: int | None = None
    newlines: array | None = None
    tokens: list[Token] = field(default_factory=list)
    comments: list[Token] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.past, self.end = False, len(self.body)
        if self.newlines is None:
            self.newlines = array("Q", (m.start() for m in re.finditer("\n", self.body)))
        self._lex(self.begin, len(self.body), None)
        self._match()
        self.comment_ends = {c.stop: c for c in self.comments}
        self._starts = [t.start for t in self.tokens]

    def _lex(self, at: int, end: int, stop_at: str | None) -> int:
        lang, body = self.language, self.body
        script = lang in ("typescript", "javascript")
        string = re.compile(STRINGS[lang], re.S)
        word, number, op = re.compile(_WORD), re.compile(_NUMBER), re.compile(_OPS, re.S)
        declared = re.compile(rf"[ \t]*\r?\n(?:{_DECLARED[lang]})\b") if lang in _DECLARED else None
        depth = 0
        while at < end:
            c = body[at]
            if c in " \t\r\n\f\v":
                at += 1
                continue
            two = body[at : at + 2]
            if two == "//":
                stop = body.find("\n", at)
                stop = end if stop < 0 else stop
                stop -= body[stop - 1] == "\r"
                self.comments.append(Token("comment", body[at:stop], at, stop))
                at = stop
                continue
            if two == "/*":
                stop = self._block_end(at, lang in ("rust", "dart"))
                self.comments.append(Token("comment", body[at:stop], at, stop))
                at = stop
                continue
            if c == "#" and lang == "csharp" and body[body.rfind("\n", 0, at) + 1 : at].strip() == "":
                stop = body.find("\n", at)
                at = end if stop < 0 else stop
                continue
            if script and c == "`":
                at = self._template(at, end)
                continue
            if script and c == "/" and (not self.tokens or self.tokens[-1].text in _REGEX_BEFORE):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(body, at)
                if m:
                    self.tokens.append(Token("string", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = string.match(body, at)
            if m:
                self.tokens.append(Token("string", m[0], at, m.end()))
                at = m.end()
                continue
            if lang == "rust" and c == "'" and (m := word.match(body, at + 1)):
                self.tokens.append(Token("lifetime", body[at : m.end()], at, m.end()))
                at = m.end()
                continue
            for kind, pattern in (("word", word), ("number", number), ("op", op)):
                m = pattern.match(body, at)
                if m:
                    break
            if kind == "op":
                depth += (m[0] == "{") - (m[0] == "}")
                if depth < 0:
                    if stop_at:
                        return at
                    depth = 0
            self.tokens.append(Token(kind, m[0], at, m.end()))
            at = m.end()
            if m[0] == "}" and not depth and not stop_at and self.most and len(self.tokens) >= self.most and declared and declared.match(body, at):
                self.end = at
                return at
        return end

    def _block_end(self, at: int, nested: bool) -> int:
        if not nested:
            stop = self.body.find("*/", at + 2)
            return len(self.body) if stop < 0 else stop + 2
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.body, at):
            depth += 1 if m[0] == "/*" else -1
            if depth == 0:
                return m.end()
        return len(self.body)

    def _template(self, at: int, end: int) -> int:
        """A template literal: its text is one string, what it interpolates are tokens."""
        start, at = at, at + 1
        self.tokens.append(Token("string", "`", start, start + 1))
        while at < end:
            c = self.body[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif self.body.startswith("${", at):
                at = self._lex(at + 2, end, "}") + 1
            else:
                at += 1
        return end

    def _match(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                # an unmatched closer of another kind is passed over, unless a brace shows that inner ones were never closed
                k = len(stack) - 1
                while k >= 0 and self.tokens[stack[k]].text != _CLOSE[t.text] and t.text == "}":
                    k -= 1
                if k >= 0 and self.tokens[stack[k]].text == _CLOSE[t.text]:
                    for j in stack[k + 1 :]:
                        self.partner[j] = i
                    self.partner[stack[k]], self.partner[i] = i, stack[k]
                    del stack[k:]
        self.past = bool(stack)
        for j in stack:
            self.partner[j] = len(self.tokens) - 1

    # --- places

    def text(self, start: int, stop: int) -> str:
        return utf8(self.body[start:stop])

    def span(self, a: int, b: int) -> str:
        """The text of tokens [a, b), as far as there are any."""
        a, b = max(a, 0), min(b, len(self.tokens))
        return self.text(self.tokens[a].start, self.tokens[b - 1].stop) if a < b else ""

    def position(self, at: int) -> tuple[int, int]:
        """Line from 1 and byte column from 0."""
        n = bisect_right(self.newlines, at - 1)
        return n + 1, at - (self.newlines[n - 1] + 1 if n else 0)

    # --- moving

    def at(self, i: int) -> str:
        if 0 <= i < len(self.tokens):
            return self.tokens[i].text
        self.past = self.past or i >= 0
        return ""

    def is_word(self, i: int) -> bool:
        if 0 <= i < len(self.tokens):
            return self.tokens[i].kind == "word"
        self.past = self.past or i >= 0
        return False

    def after(self, i: int) -> int:
        """The token after i, or after the partner of a bracket."""
        return self.partner.get(i, i) + 1 if self.at(i) in _OPEN else i + 1

    def find(self, i: int, stop: int, *wanted: str) -> int:
        """The first of the wanted tokens outside brackets from i on, stop if there is none."""
        while i < stop:
            if self.tokens[i].kind == "op" and self.tokens[i].text in wanted or self.tokens[i].kind == "word" and self.tokens[i].text in wanted:
                return i
            i = self.after(i)
        self.past = self.past or stop >= len(self.tokens)
        return stop

    def skip_angles(self, i: int, stop: int) -> int:
        """Past <...> if i is its <, else i."""
        if self.at(i) != "<":
            return i
        depth, k = 0, i
        while k < stop:
            t = self.at(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif t in (";", "}") or t == "{" and depth == 0:
                return i
            k = self.after(k) if t in ("(", "[", "{") else k + 1
        self.past = self.past or stop >= len(self.tokens)
        return i

    def comments_before(self, start: int, floor: int) -> list[Token]:
        """Comments that end between the last token before start and start, nearest first."""
        out = []
        at = start
        while at > floor:
            gap = len(self.body[floor:at]) - len(self.body[floor:at].rstrip())
            c = self.comment_ends.get(at - gap)
            if c is None or c.start < floor:
                break
            out.append(c)
            at = c.start
        return out


def pieces(body: str, language: str, walk: Callable[[Source], object], most: int | None = None) -> Iterator[object]:
    """What walk finds in each piece of a text, in order, so that only one piece's tokens are held at a time.

    Pieces found are those of the whole text: one that can't be read alone is taken again with what comes after it.
    """
    begin, newlines = 0, None
    n = most = most or PIECE
    while True:
        src = Source(body, language, begin, n, newlines)
        newlines, last = src.newlines, src.end == len(body)
        try:
            found = walk(src)
        except (IndexError, KeyError):
            if last:
                raise
            src.past = True
        if src.past and not last:
            n *= 2
            continue
        yield found
        if last:
            return
        begin, n = src.end, most


def utf8(latin: str) -> str:
    try:
        return latin.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return ""
