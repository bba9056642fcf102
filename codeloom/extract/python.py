"""Python by the standard library's parser; where that fails, by indentation."""

from __future__ import annotations

import ast
import re

from .model import Report


def extract(report: Report, text: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        by_indentation(report, text)
        return
    for top in tree.body:
        if isinstance(top, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            report.defined.add(top.name)
        elif isinstance(top, ast.ImportFrom) and top.module and not top.level:
            report.imported |= {a.asname or a.name: top.module for a in top.names if a.name != "*"}
    _walk(report, tree, None, None)


def _base(node: ast.expr) -> str | None:
    return ast.unparse(node) if isinstance(node, ast.Name | ast.Attribute) else None


def _params(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    return f"({ast.unparse(node.args)})"


def _called(node: ast.Call) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _walk(report: Report, node: ast.AST, cls: str | None, func: str | None) -> None:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.ClassDef):
            for d in child.decorator_list:
                _walk(report, ast.Expression(d), cls, func)
            bases = [b for b in map(_base, child.bases) if b]
            report.klass(child.name, child.lineno, child.end_lineno, cls, bases)
            for part in child.body:
                _walk(report, ast.Module([part], []), child.name, None)
        elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in child.decorator_list:
                _walk(report, ast.Expression(d), cls, func)
            returns = ast.unparse(child.returns) if child.returns else None
            q = report.function(child.name, child.lineno, child.end_lineno, cls, params=_params(child), return_type=returns)
            _walk(report, child.args, cls, q)
            for part in child.body:
                _walk(report, ast.Module([part], []), cls, q)
        elif isinstance(child, ast.Import):
            for a in child.names:
                if not a.asname:
                    report.imports(a.name, child.lineno)
        elif isinstance(child, ast.ImportFrom):
            report.imports(child.module if child.module and not child.level else child.names[0].name, child.lineno)
        else:
            if isinstance(child, ast.Call) and func and (name := _called(child)):
                report.call(func, name, child.lineno)
            _walk(report, child, cls, func)


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?")
_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(.*)")
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w.]+(?:[ \t]*,[ \t]*[\w.]+)*)[ \t]*(?:#.*)?$")
_CALL = re.compile(r"(?<![\w.])(?:\w+\.)*(\w+)[ \t]*\(")
_KEYWORDS = frozenset("if for while return and or not in is lambda yield assert del elif else except with print def class async await raise from import".split())


def by_indentation(report: Report, text: str) -> None:
    """Definitions, imports and calls of a file that does not parse."""
    lines = text.split("\n")
    found = [(len(m[1].expandtabs()), m[2], m[3], m[4], i) for i, line in enumerate(lines) if (m := _DEF.match(line))]

    def last_line(indent: int, start: int) -> int:
        end = start
        for i in range(start + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i].expandtabs()) - len(lines[i].expandtabs().lstrip()) <= indent:
                    break
                end = i
        return end

    report.defined |= {name for indent, _, name, _, _ in found if not indent}
    spans = []
    for indent, kind, name, args, i in found:
        end = last_line(indent, i)
        around = [s for s in spans if s[1] < i <= s[2]]
        classes = [s for s in around if s[0] == "class"]
        cls = classes[-1][3] if classes else None
        if kind == "class":
            report.klass(name, i + 1, end + 1, cls, [b.strip() for b in (args or "").split(",") if re.fullmatch(r"\s*[\w.]+\s*", b)])
            spans.append(("class", i, end, name, None))
        else:
            q = report.function(name, i + 1, end + 1, cls, params=f"({args or ''})")
            spans.append(("def", i, end, name, q))
    for i, line in enumerate(lines):
        if m := _FROM.match(line):
            report.imports(m[1], i + 1)
            report.imported |= {(a.split(" as ")[-1]).strip(): m[1] for a in m[2].strip("() ").split(",") if a.strip()}
        elif m := _IMPORT.match(line):
            for name in m[1].split(","):
                report.imports(name.strip(), i + 1)
        elif not _DEF.match(line) and (inside := [s for s in spans if s[0] == "def" and s[1] < i <= s[2]]):
            for m in _CALL.finditer(line.split("#")[0]):
                if m[1] not in _KEYWORDS:
                    report.call(inside[-1][4], m[1], i + 1)
