"""What Solidity has beyond classes, functions and calls: used libraries, modifiers of functions, variables of contracts, constants."""

from __future__ import annotations

import re
from collections.abc import Callable

from .model import Report

_USING = re.compile(r"\busing\s+([\w.]+)\s+for\b")
_PART = re.compile(r"([A-Za-z_$][\w$.]*)\s*(\([^()]*\))?")
_HEAD_WORDS = frozenset("public private internal external view pure payable virtual override returns constant".split())
_MARKS = r"(?:(?:public|private|internal|constant|immutable|override|transient)\s+)*"
_VARIABLE = re.compile(rf"(?:^|(?<=[;{{]))\s*(mapping\s*\(.*?\)(?=\s+[A-Za-z_$])|[A-Za-z_$][\w$.]*(?:\s*\[[^\]]*\])*)\s+({_MARKS})([A-Za-z_$][\w$]*)\s*(?:=[^;]*)?;", re.DOTALL)
_NO_TYPE = frozenset("abstract constructor contract emit enum error event function import interface library modifier pragma return struct type using".split())


def flat(code: str, start: int, end: int) -> str:
    """``code[start:end]`` at its own depth: inner blocks are blank, and their end ends the statement."""
    out, depth = [], 0
    for c in code[start:end]:
        depth += c == "{"
        out.append(c if not depth or c == "\n" else ";" if c == "}" and depth == 1 else " ")
        depth -= c == "}" and depth > 0
    return "".join(out)


def extend(report: Report, code: str, line: Callable[[int], int], classes: list[tuple], functions: list[tuple[int, int, str]]) -> None:
    """``classes``: (start, end, name, head, place of the name); ``functions``: (start of the name, end, qualified name)."""
    outer = lambda at: max((c for c in classes if c[0] < at < c[1]), key=lambda c: c[0], default=None)
    holder = lambda c: report.qualified(c[2]) if c else report.path
    for m in _USING.finditer(code):
        report.edges.append(("DEPENDS_ON", holder(outer(m.start())), m[1].rsplit(".", 1)[-1], line(m.start()), None))

    for start, _, q in functions:
        head = re.compile(r"[^{;]*").match(code, start)
        params = re.compile(r"[\w$]*\s*\([^()]*\)").match(code, start)
        for m in _PART.finditer(code, params.end(), head.end()) if params else ():
            if m[1] not in _HEAD_WORDS and not m[2]:  # with arguments it reads as a call
                report.edges.append(("CALLS", q, m[1].rsplit(".", 1)[-1], line(m.start()), None))

    def variable(m: re.Match, shift: int, c: tuple | None, extra: dict) -> None:
        marks = m[2].split()
        seen = [w for w in marks if w in ("public", "private", "internal")]
        first, last = line(shift + m.start(1)), line(shift + m.end() - 1)
        q = report.node("Function", m[3], first, last, c[2] if c else None, return_type=" ".join(m[1].split()), modifiers=seen[0] if seen else None, extra=extra)
        report.edges.append(("CONTAINS", holder(c), q, first, None))

    for c in classes:
        opening = code.find("{", c[4], c[1])
        if opening < 0 or not re.match(r"(?:abstract\s+)?(?:contract|interface|library)\b", code[c[0] : c[4]]):
            continue
        for m in _VARIABLE.finditer(flat(code, opening + 1, c[1] - 1)):
            if m[1].split()[0] not in _NO_TYPE:
                fixed = [w for w in m[2].split() if w in ("constant", "immutable")]
                variable(m, opening + 1, c, {"solidity_kind": "state_variable", "mutability": fixed[0] if fixed else None})
    for m in _VARIABLE.finditer(flat(code, 0, len(code))):
        if "constant" in m[2].split() and m[1].split()[0] not in _NO_TYPE:
            variable(m, 0, None, {"solidity_kind": "constant"})
