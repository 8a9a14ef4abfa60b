"""Column functions over paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(path: Column, root: str) -> Column:
    """The path below the root, with forward slashes."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(flat, F.lit(base)), F.substr(flat, F.lit(len(base) + 1))).otherwise(flat)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What lies before the last slash; empty for a path without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """What follows the last dot of the name, null if there is none or the name begins with its only dot."""
    return F.nullif(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1), F.lit(""))


def module_path(path: Column, language: Column) -> Column:
    """The module that a path stands for, in the five languages where the path alone says it."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    joined = lambda p, sep: F.replace(p, F.lit("/"), F.lit(sep))
    inner = lambda names: F.regexp_replace(bare, rf"(^|/)(?:{names})$", "")
    rust = F.when(bare.rlike("(^|/)mod$"), inner("mod")).when(bare.rlike("(^|/)(lib|main)$"), inner("lib|main")).otherwise(bare)
    js = F.when(basename(path).rlike(r"^index\.(js|jsx|mjs|cjs)$"), inner("index")).otherwise(bare)
    ts = F.when(basename(path).rlike(r"^index\.tsx?$"), inner("index")).otherwise(bare)
    return (
        F.when(language == "python", joined(F.when(basename(path) == "__init__.py", inner("__init__")).otherwise(bare), "."))
        .when(language == "rust", joined(rust, "::"))
        .when(language == "typescript", joined(ts, "::"))
        .when(language == "javascript", joined(js, "::"))
        .otherwise(joined(bare, "::"))
    )


def host(url: Column) -> Column:
    """The host of an address as a folder name: other characters than letters, digits, dot, dash and underscore become underscores."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce(F.nullif(F.regexp_replace(found, "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("local"))


def url_extension(url: Column) -> Column:
    """The extension of the last part of an address's path if it has 1 to 10 ASCII letters and digits, else bin."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,10})$", 1), F.lit("")), F.lit("bin"))


def levels(path: Column, root: str, depth: int) -> Column:
    """The directories from the root to the path's own, at most depth below the root; each of them counts what lies in the path."""
    own = directory(path)
    below = F.when(own == root, F.lit("")).otherwise(F.substr(own, F.lit(len(root) + 2)) if root else own)
    parts = F.slice(F.filter(F.split(below, "/", -1), lambda x: x != ""), 1, depth)
    up_to = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.lit(root) if root else F.array().cast("array<string>"), F.slice(parts, 1, n)))
    return up_to
