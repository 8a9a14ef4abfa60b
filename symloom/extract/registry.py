"""Which extractor reads which language; more can be registered."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

from symloom.extract.record import Found
from symloom.sources.registry import EXTENSIONS

#: An extractor takes a file's bytes as Latin-1 text and its module path.
Extractor = Callable[[str, str], Found]
_BUILT_IN = {
    "rust": ("rust", "extract"), "python": ("python", "extract"), "typescript": ("script", "typescript"), "javascript": ("script", "javascript"),
    "go": ("go", "extract"), "java": ("java", "extract"), "csharp": ("csharp", "extract"), "dart": ("dart", "extract"),
}
_more: dict[str, Extractor] = {}
_more_modules: dict[str, Callable[[str], str]] = {}


def register(language: str, extensions: list[str], extractor: Extractor, module_path: Callable[[str], str] | None = None) -> None:
    """Adds a language or replaces one. The extractor is sent to the workers with the task, so it can be any picklable function."""
    _more[language] = extractor
    if module_path:
        _more_modules[language] = module_path
    for e in extensions:
        EXTENSIONS[e] = language


def registered() -> tuple[dict[str, Extractor], dict[str, Callable[[str], str]]]:
    """What was registered beyond the built-in languages, to be sent to workers."""
    return dict(_more), dict(_more_modules)


def extractor(language: str, more: dict[str, Extractor] | None = None) -> Extractor | None:
    if more and language in more:
        return more[language]
    if language in _BUILT_IN:
        module, name = _BUILT_IN[language]
        return getattr(importlib.import_module(f"symloom.extract.langs.{module}"), name)
    return None


def pieces(language: str, body: str, module: str, more: dict[str, Extractor] | None = None) -> Iterator[Found]:
    """What a file holds, piece by piece; what is found by an extractor that was registered is one piece."""
    if more and language in more:
        yield more[language](body, module)
    elif language in _BUILT_IN:
        at, name = _BUILT_IN[language]
        yield from getattr(importlib.import_module(f"symloom.extract.langs.{at}"), "pieces" if name == "extract" else f"{name}_pieces")(body, module)


def module_path(path: str, language: str, more: dict[str, Callable[[str], str]] | None = None) -> str:
    """The module that a path stands for; the row-wise twin of functions.paths.module_path."""
    if more and language in more:
        return more[language](path)
    folder, _, last = path.rpartition("/")
    stem = last.rpartition(".")[0] or ("" if last.startswith(".") else last)
    if language == "rust" and last in ("lib.rs", "main.rs", "mod.rs") or language == "python" and last == "__init__.py":
        stem = ""
    elif language in ("typescript", "javascript") and re.fullmatch(r"index\.(tsx?|jsx?|mjs|cjs)", last):
        stem = ""
    if language == "go":
        return folder.rpartition("/")[2]
    sep = "." if language == "python" else "::"
    return sep.join([*[x for x in folder.split("/") if x], *([stem] if stem else [])])
