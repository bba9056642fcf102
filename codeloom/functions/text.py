"""Text functions over paths, names and nodes."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp",
    ".rb": "ruby", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".kt": "kotlin", ".swift": "swift", ".php": "php", ".sol": "solidity",
}

# Names of test functions and paths of test files.
TEST_NAME = r"^test_|^Test|_test$|\.test\.|\.spec\.|_spec$"
TEST_FILE = r"test_.*\.py$|.*_test\.py$|.*\.test\.[jt]sx?$|.*\.spec\.[jt]sx?$|.*_test\.go$|tests?/"

NAME_LIMIT = 256
BINARY_PREFIX = 8192


def qualified_name(kind: Column, file_path: Column, parent: Column, name: Column) -> Column:
    """A File's path; else ``file::parent.name``, or ``file::name`` without a parent."""
    inner = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."), name)).otherwise(name)
    return F.when(kind == "File", file_path).otherwise(F.concat(file_path, F.lit("::"), inner))


def sanitize_name(s: Column, limit: int = NAME_LIMIT) -> Column:
    """Without control characters below space, except tab and line feed; at most ``limit`` characters."""
    return F.substring(F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F]", ""), 1, limit)


def detect_language(path: Column) -> Column:
    """Language by the lower-cased suffix of the last path component; null when unknown."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, suffix) if suffix is not None else None


def is_test_name(name: Column) -> Column:
    return name.rlike(TEST_NAME)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def ignore_regex(patterns: Iterable[str]) -> str:
    """One anchored expression for all shell patterns; ``*`` crosses folders and a pattern covers the whole path."""
    each = [re.sub(r"^\(\?s:|\)\\[Zz]$", "", fnmatch.translate(p)) for p in patterns]
    return "(?s)^(?:" + "|".join(f"(?:{p})" for p in each) + r")\z" if each else r"(?!)"


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    return path.rlike(ignore_regex(patterns))


def binary_content(content: Column) -> Column:
    """A NUL among the first bytes; unreadable (null) content counts as binary."""
    return F.coalesce(F.position(F.lit(b"\x00"), F.substring(content, 1, BINARY_PREFIX)) > 0, F.lit(True))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def node_text(name: Column, kind: Column, parent: Column, params: Column, return_type: Column, language: Column) -> Column:
    """What an embedding is made from: name, kind, parent, parameters, return type, language; empty parts are left out."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(
        " ", some(name), F.when(kind != "File", some(F.lower(kind))), F.concat(F.lit("in "), some(parent)), some(params), F.concat(F.lit("returns "), some(return_type)), some(language)
    )
