"""The same questions in SQL for another engine, as common table expressions over the star-schema tables."""

from __future__ import annotations

import re

from symloom.sources.projection import COLUMNS, NEW_FILES_OTHER, ORDER, SOURCES, SQL


def _plain(text: str) -> str:
    return re.sub(r"\{(" + "|".join([*SOURCES, "new_files"]) + r")\}", r"\1", text)


def _numbered(name: str) -> str:
    cols = ", ".join(c for c in COLUMNS[name] if c != "id")
    return f"SELECT row_number() OVER (ORDER BY {', '.join(ORDER[name])}) AS id, {cols} FROM ({_plain(SQL[name])})"


def _resolved(table: str, raw: str, into: str) -> str:
    return f"SELECT x.*, q.id AS by_qname, l.id AS by_name, coalesce(q.id, l.id) AS {into} FROM {table} x LEFT JOIN qn q ON q.qualified_name = x.{raw} LEFT JOIN ln l ON l.file_id = x.file_id AND l.name = x.{raw}"


CTES: dict[str, tuple[str, list[str]]] = {
    "files": (_plain(SQL["files"]), []),
    "symbols": (_plain(SQL["symbols"]), []),
    "calls": (_numbered("calls"), []),
    "types": (_numbered("types"), []),
    "imports": (_plain(SQL["imports"]), []),
    "refs": (_plain(SQL["refs"]), []),
    "new_files": (_plain(NEW_FILES_OTHER), []),
    "old_files": (_plain(SQL["old_files"]), ["new_files"]),
    "qn": ("SELECT qualified_name, min(id) AS id, arg_min(file_id, id) AS file_id FROM symbols GROUP BY qualified_name", ["symbols"]),
    "ln": ("SELECT file_id, name, min(id) AS id FROM symbols GROUP BY file_id, name", ["symbols"]),
    "rcalls": (_resolved("calls", "callee_raw_name", "callee_symbol_id"), ["calls", "qn", "ln"]),
    "rtypes": (_resolved("types", "target_raw_name", "target_symbol_id"), ["types", "qn", "ln"]),
    "rrefs": (_resolved("refs", "raw_name", "symbol_id"), ["refs", "qn", "ln"]),
    "rimports": ("SELECT i.*, q.id AS resolved_symbol_id, q.file_id AS resolved_file_id FROM imports i LEFT JOIN qn q ON q.qualified_name = i.raw_path", ["imports", "qn"]),
    "iedges": ("SELECT i.id, i.file_id, s.id AS top, i.resolved_symbol_id FROM rimports i JOIN symbols s ON s.file_id = i.file_id AND s.parent_symbol_id IS NULL WHERE i.resolved_symbol_id IS NOT NULL", ["rimports", "symbols"]),
    "directed": (
        """SELECT id AS a, parent_symbol_id AS b, 'parent' AS kind, 0 AS kind_rank, id AS row_id, 0::BIGINT AS top_id FROM symbols WHERE parent_symbol_id IS NOT NULL
        UNION ALL SELECT caller_symbol_id, callee_symbol_id, 'call', 1, id, 0 FROM rcalls WHERE callee_symbol_id <> caller_symbol_id
        UNION ALL SELECT symbol_id, target_symbol_id, 'type', 2, id, 0 FROM rtypes WHERE target_symbol_id <> symbol_id
        UNION ALL SELECT top, resolved_symbol_id, 'import', 3, id, top FROM iedges WHERE top <> resolved_symbol_id""",
        ["symbols", "rcalls", "rtypes", "iedges"],
    ),
    "edges": ("SELECT a AS src, b AS dst, kind, kind_rank, row_id, top_id FROM directed UNION ALL SELECT b, a, kind, kind_rank, row_id, top_id FROM directed", ["directed"]),
    "within": (
        """SELECT id AS site_id, enclosing_id FROM (SELECT r.id, s.id AS enclosing_id, row_number() OVER (PARTITION BY r.id ORDER BY s.end_line - s.start_line, s.id) AS n
        FROM refs r LEFT JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.start_line AND s.end_line) WHERE n = 1""",
        ["refs", "symbols"],
    ),
    "callers": ("SELECT s.id, count(c.id) AS caller_count FROM symbols s LEFT JOIN rcalls c ON c.callee_symbol_id = s.id GROUP BY s.id", ["symbols", "rcalls"]),
}


def using(names: str, body: str) -> str:
    """The body after the definitions of the named tables and of all that they need."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in done:
            for other in CTES[name][1]:
                need(other)
            done[name] = CTES[name][0]

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + "\n" + body
