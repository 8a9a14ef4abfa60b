"""Ignore files: which paths below a root their patterns leave out."""

from __future__ import annotations

import re


def _pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Ignore:
    """The rules of ignore files by the directory ('' for the root) in which each lies."""

    def __init__(self, files: dict[str, str]) -> None:
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []
        for folder in sorted(files, key=lambda f: (f.count("/") if f else -1, f)):
            for line in files[folder].splitlines():
                line = re.sub(r"(?<!\\) +$", "", line)
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                body = line[1:] if keep or line.startswith(("\\#", "\\!")) else line
                only_dirs = body.endswith("/")
                body = body.rstrip("/")
                anchored = "/" in body
                body = body.lstrip("/")
                prefix = re.escape(folder + "/") if folder else ""
                regex = re.compile(prefix + ("" if anchored else "(?:.*/)?") + _pattern(body) + r"\Z", re.S)
                self.rules.append((folder, regex, only_dirs, keep))

    def _one(self, path: str, is_dir: bool) -> bool | None:
        verdict = None
        for _, regex, only_dirs, keep in self.rules:
            if (is_dir or not only_dirs) and regex.match(path):
                verdict = not keep
        return verdict

    def ignored(self, path: str) -> bool:
        """Whether a file is left out, by itself or with a directory above it."""
        parts = path.split("/")
        return any(self._one("/".join(parts[:n]), True) for n in range(1, len(parts))) or bool(self._one(path, False))
