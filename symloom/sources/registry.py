"""File extensions and the languages that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.paths import extension

EXTENSIONS = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "go": "go", "dart": "dart", "java": "java", "cs": "csharp",
}


def supported_languages() -> list[str]:
    return sorted(set(EXTENSIONS.values()))


def supported_extensions() -> list[str]:
    return sorted(EXTENSIONS)


def with_language(files: DataFrame, extensions: dict[str, str] | None = None, path: str = "path") -> DataFrame:
    """Files whose extension is registered, case as it is written, with their language; a dozen rows are looked up in a literal map."""
    table = extensions or EXTENSIONS
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return files.withColumn("language", F.element_at(F.create_map(*pairs), F.coalesce(extension(F.col(path)), F.lit("")))).where("language IS NOT NULL")
