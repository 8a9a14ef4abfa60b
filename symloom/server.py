"""The read verbs over lines of JSON-RPC 2.0."""

from __future__ import annotations

import json
from typing import Any, TextIO

from symloom import render
from symloom.index import Index
from symloom.operators.lookup import Ambiguous

PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603
PROTOCOL = "2024-11-05"


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        self.code, self.message = code, message
        super().__init__(message)


def _tool(name: str, what: str, required: list[str], **kinds: str) -> dict:
    return {"name": name, "description": what, "inputSchema": {"properties": {k: {"type": t} | ({"minimum": 0} if t == "integer" else {}) for k, t in kinds.items()}, "required": required, "type": "object"}}


TOOLS = [
    _tool("follow", "A symbol's definition, as much of its text as the budget (1500) takes, and who calls it.", ["symbol"], symbol="string", **{"from": "string"}, budget="integer"),
    _tool("refs", "Where a symbol is used, 20 places unless limit says otherwise.", ["symbol"], symbol="string", limit="integer"),
    _tool("query", "Symbols around a question, by a walk of the graph under a budget (2000).", ["question"], question="string", dfs="boolean", budget="integer"),
    _tool("explain", "A symbol's neighbours by kind.", ["symbol"], symbol="string"),
    _tool("path", "The shortest way between two symbols.", ["from", "to"], **{"from": "string"}, to="string"),
    _tool("slice", "What surrounds FILE:LINE, within a budget (1500).", ["location"], location="string", budget="integer"),
    _tool("map", "Directories with their symbols, to a depth (2).", [], scope="string", depth="integer"),
]
_PYTHON = {"string": str, "integer": int, "boolean": bool}


class Server:
    def __init__(self, index: Index) -> None:
        self.index = index

    def serve(self, lines: TextIO, out: TextIO) -> None:
        """Answers line by line until the input ends."""
        for line in lines:
            answer = self.handle(line.strip()) if line.strip() else None
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()

    def handle(self, line: str) -> dict | None:
        """The answer to a message; None for a notification."""
        try:
            message = json.loads(line)
        except ValueError as e:
            return self._error(None, PARSE_ERROR, f"not JSON: {e}")
        if not isinstance(message, dict):
            return self._error(None, INVALID_REQUEST, "not an object")
        asked, method = "id" in message, message.get("method")
        if not isinstance(method, str):
            return self._error(message["id"], INVALID_REQUEST, "no method") if asked else None
        try:
            result = self._dispatch(method, message.get("params") or {})
        except RpcError as e:
            return self._error(message["id"], e.code, e.message) if asked else None
        except Exception as e:
            return self._error(message["id"], INTERNAL_ERROR, str(e)) if asked else None
        return {"jsonrpc": "2.0", "id": message["id"], "result": result} if asked else None

    @staticmethod
    def _error(id_: Any, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": dict(message=text, code=code)}

    def _dispatch(self, method: str, params: dict) -> Any:
        if method == "initialize":
            return {"serverInfo": dict(name="symloom", version="1"), "protocolVersion": PROTOCOL, "capabilities": dict(tools={})}
        if method == "tools/list":
            return {"tools": TOOLS}
        if method in ("shutdown", "initialized", "notifications/initialized", "exit", "ping"):
            return {} if method == "ping" else None
        if method != "tools/call":
            raise RpcError(METHOD_NOT_FOUND, f"no such method: {method}")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            raise RpcError(INVALID_PARAMS, "tools/call needs a name")
        tool = next((t for t in TOOLS if t["name"] == params["name"]), None)
        if tool is None:
            raise RpcError(INVALID_PARAMS, f"no such tool: {params['name']}")
        given, spec = params.get("arguments") or {}, tool["inputSchema"]
        for key in spec["required"]:
            if key not in given:
                raise RpcError(INVALID_PARAMS, f"{key} is missing")
        for key, value in given.items():
            kind = spec["properties"].get(key, {}).get("type")
            if kind and value is not None and (not isinstance(value, _PYTHON[kind]) or kind == "integer" and (isinstance(value, bool) or value < 0)):
                raise RpcError(INVALID_PARAMS, f"{key} must be a {kind}")
        if not self.index.store.exists():
            raise RpcError(INTERNAL_ERROR, f"no index at {self.index.root}; build it first")
        self.index.ensure_fresh()
        block = dict(text=self.call(params["name"], given), type="text")
        return {"isError": False, "content": [block]}

    def call(self, name: str, a: dict) -> str:
        ix = self.index
        if name == "query":
            return render.query(ix.query(a["question"], bool(a.get("dfs")), a.get("budget", 2000)))
        if name == "map":
            return render.map_(ix.map(a.get("scope"), a.get("depth", 2)))
        if name == "slice":
            path, _, line = a["location"].rpartition(":")
            if not path or not line.isdigit():
                raise RpcError(INVALID_PARAMS, "location must be FILE:LINE")
            found = ix.slice(path, int(line), a.get("budget", 1500))
            if found is None:
                raise RpcError(INVALID_PARAMS, f"nothing is indexed at {a['location']}")
            return render.slice_(a["location"], found)
        if name == "path":
            return render.path(a["from"], a["to"], ix.path(self._symbol(a["from"]), self._symbol(a["to"])))
        sid = self._symbol(a["symbol"], a.get("from"))
        if name == "follow":
            return render.follow(a["symbol"], ix.follow(sid, a.get("budget", 1500)))
        if name == "refs":
            return render.refs(a["symbol"], a.get("limit", 20), ix.refs(sid, a.get("limit", 20)))
        return render.explain(ix.explain(sid))

    def _symbol(self, text: str, at: str | None = None) -> int:
        try:
            sid = self.index.find(text, at)
        except Ambiguous as e:
            raise RpcError(INVALID_PARAMS, str(e)) from e
        if sid is None:
            raise RpcError(INVALID_PARAMS, f"no symbol matches '{text}'")
        return sid
