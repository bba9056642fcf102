"""Languages with blocks, by a tokenizer and a scope tracker.

Comments and strings are blanked, declarations are found by the language's patterns, their extents by matching brackets
(or ``end`` words in Ruby), and each declaration belongs to the innermost class around it. This recovers the row contract
of the other extractors without a grammar; it is an approximation and says so in the README.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from . import solidity
from .model import Report

_ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Syntax:
    """Patterns of one language. Group 1 of ``classes`` and ``functions`` is the name; ``bases`` runs over a class's head."""

    classes: str
    functions: tuple[str, ...]
    imports: str
    bases: str | None = None
    calls: str = rf"({_ID})\s*(?:<[^<>;(){{}}]*>)?\s*\("
    methods: tuple[str, ...] = ()  #: looked for directly inside classes
    hash_comments: bool = False
    ends: bool = False  #: blocks close with ``end``


_C_FUNCTION = rf"(?m)^[ \t]*(?:[\w:<>,*&\[\]]+[\s*&]+)+?((?:{_ID}::)*~?{_ID})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const\s*|noexcept\s*|override\s*)*(?::[^;{{]*)?\{{"
_BEGIN = r"(?m)(?:^|(?<=[{};]))\s*"
_NOT_TYPE = r"(?!(?:return|throw|new|else|await|yield|case|goto|in|package|import|using)\b)"
_MODIFIERS = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|partial|default|native|readonly|unsafe|extern)\s+)*"
_PARAMS = r"\s*\([^;{}]*?\)\s*"
_TYPED_METHOD = rf"{_BEGIN}{_MODIFIERS}{_NOT_TYPE}(?:<[^>]+>\s*)?[\w.<>,\[\]?]+\s+({_ID}){_PARAMS}(?:throws\s+[\w.,\s]+)?(?:\{{|=>|;)"
_CONSTRUCTOR = rf"{_BEGIN}{_MODIFIERS}{_NOT_TYPE}({_ID}){_PARAMS}(?:throws\s+[\w.,\s]+)?(?::\s*(?:base|this)\([^)]*\)\s*)?\{{"
_JS = Syntax(
    rf"\bclass\s+({_ID})[^{{;]*\{{", (rf"\bfunction\s*\*?\s*({_ID})\s*(?:<[^>]*>)?\(",), r"""\bimport\b[^;'"]*['"]([^'"]+)['"]""", rf"\b(?:extends|implements)\s+([\w$.]+(?:\s*,\s*[\w$.]+)*)",
    methods=(rf"{_BEGIN}(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*({_ID})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?::[^{{;=]+)?\{{",),
)

SYNTAX: dict[str, Syntax] = {
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": Syntax(rf"\btype\s+({_ID})\s+(?:struct|interface)\s*\{{", (rf"\bfunc\s+({_ID})\s*(?:\[[^\]]*\])?\(",), r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "rust": Syntax(rf"\b(?:struct|enum|impl(?:\s*<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+({_ID})[^;{{(]*[{{;(]", (rf"\bfn\s+({_ID})\s*(?:<[^>]*>)?\(",), r"\buse\s+([^;]+);", calls=rf"({_ID})!?\s*[(\[{{]|({_ID})\s*\("),
    "java": Syntax(rf"\b(?:class|interface|enum)\s+({_ID})[^{{;]*\{{", (), r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", r"\b(extends\s+[\w.<>]+|implements\s+[\w.<>,\s]+?)(?=\s+implements|\s*\{)", methods=(_TYPED_METHOD, _CONSTRUCTOR)),
    "csharp": Syntax(rf"\b(?:class|interface|enum|struct)\s+({_ID})[^{{;]*\{{", (), r"\busing\s+(?:static\s+)?([\w.]+)\s*;", r":\s*([\w.<>,\s]+)", methods=(_TYPED_METHOD, _CONSTRUCTOR)),
    "c": Syntax(rf"\b(?:typedef\s+)?struct\s+({_ID})\s*\{{", (_C_FUNCTION,), r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"]+[>\"])"),
    "cpp": Syntax(rf"\b(?:class|struct)\s+({_ID})\s*(?:final\s*)?(?::[^{{;]*)?\{{", (_C_FUNCTION,), r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"]+[>\"])", r":\s*((?:\s*,?\s*(?:public|private|protected|virtual)?\s*[\w:]+)+)"),
    "kotlin": Syntax(rf"\b(?:class|interface|object)\s+({_ID})[^{{\n]*", (rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?({_ID})\s*\(",), r"(?m)^[ \t]*(import\s+[\w.*]+)", r":\s*([\w.<>(),\s]+)"),
    "swift": Syntax(rf"\b(?:class|struct|protocol)\s+({_ID})[^{{;]*\{{", (rf"\bfunc\s+({_ID})\s*(?:<[^>]*>)?\(",), r"(?m)^[ \t]*(import\s+[\w.]+)"),
    "php": Syntax(rf"\b(?:class|interface)\s+({_ID})[^{{;]*\{{", (rf"\bfunction\s+&?({_ID})\s*\(",), r"(?m)^[ \t]*(use\s+[\w\\]+[^;]*;)", calls=rf"({_ID})\s*\(", hash_comments=True),
    "solidity": Syntax(
        rf"\b(?:contract|interface|library|struct|enum|error)\s+({_ID})[^{{;]*[{{;]", (rf"\b(?:function|modifier|event)\s+({_ID})", r"\b(constructor|fallback|receive)\s*\("), r"""\bimport\b[^;'"]*['"]([^'"]+)['"]""", rf"\bis\s+({_ID}(?:\s*,\s*{_ID})*)"
    ),
    "ruby": Syntax(r"(?m)^[ \t]*(?:class|module)\s+([A-Z]\w*)", (r"(?m)^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)",), r"""\brequire(?:_relative)?[ (]+['"]([^'"]+)['"]""", calls=r"(?!)", hash_comments=True, ends=True),
}

#: What a function's head says of its result, behind the parameters.
_ANNOTATION = re.compile(r"\s*(:\s*[^{};=]+?)\s*(?=[{;]|=>)")
RETURNS = {"typescript": _ANNOTATION, "tsx": _ANNOTATION, "solidity": re.compile(r"[^{};]*?\b(returns\s*\([^)]*\))")}

_NOT_CALLS = frozenset("if for while switch catch return sizeof function func fn fun def class new typeof await match when guard elif else super this constructor require echo print isset unset list array foreach using lock fixed checked unless until returns".split())


def blank(text: str, hashes: bool, keep_strings: bool = False) -> str:
    """``text`` with comments (and strings) as spaces; every line and offset stays."""
    comment = r"#[^\n]*|" if hashes else ""
    token = re.compile(comment + r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
    fill = lambda s: re.sub(r"[^\n]", " ", s)

    def one(m: re.Match) -> str:
        s = m.group()
        return s if s[0] in "\"'`" and keep_strings else fill(s)

    return token.sub(one, text)


def block_end(code: str, at: int) -> int:
    """End of the block that opens at or after ``at``; of the statement where none opens first."""
    m = re.compile(r"[{;]").search(code, at)
    if not m or m.group() == ";":
        return m.end() if m else len(code)
    depth = 0
    for b in re.compile(r"[{}]").finditer(code, m.start()):
        depth += 1 if b.group() == "{" else -1
        if not depth:
            return b.end()
    return len(code)


_RUBY = re.compile(r"(?m)^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b|\bend\b")


def ruby_end(code: str, at: int) -> int:
    depth = 0
    for m in _RUBY.finditer(code, at):
        depth += -1 if m.group() == "end" else 1
        if depth <= 0:
            return m.end()
    return len(code)


def extract(report: Report, text: str) -> None:
    syn = SYNTAX[report.language]
    code = blank(text, syn.hash_comments)
    with_strings = blank(text, syn.hash_comments, keep_strings=True)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    end_of = ruby_end if syn.ends else block_end

    classes = []
    for m in re.finditer(syn.classes, code):
        start = m.start(1)
        classes.append((m.start(), end_of(code, m.start() if syn.ends else m.end(1)), m[1], code[m.end(1) : m.end()], start))
    owner = lambda at: max((c for c in classes if c[0] < at < c[1]), key=lambda c: c[0], default=None)

    functions, taken = [], set()
    for patterns, inside in ((syn.functions, False), (syn.methods, True)):
        for p in patterns:
            for m in re.finditer(p, code):
                name = m[1].rsplit("::", 1)[-1]
                cls = owner(m.start(1))
                if m.start(1) in taken or (inside and (cls is None or name in _NOT_CALLS - {"constructor"})):
                    continue
                taken.add(m.start(1))
                end = end_of(code, m.start() if syn.ends else m.end(1))
                functions.append((m.start(1), end, name, cls[2] if cls else None))
    functions.sort()
    if report.language == "go":
        for m in re.finditer(rf"\bfunc\s*\([^)]*\)\s*({_ID})\s*\(", code):
            functions.append((m.start(1), block_end(code, m.end(1)), m[1], None))
        functions.sort()
    top = lambda at: not any(f[0] < at < f[1] for f in functions) and owner(at) is None
    report.defined |= {c[2] for c in classes if top(c[0])} | {f[2] for f in functions if f[3] is None and top(f[0])}

    for start, end, name, head, at in classes:
        outer = owner(start)
        bases = []
        if syn.bases:
            for m in re.finditer(syn.bases, head):
                parts = [m[1]] if report.language == "java" else m[1].split(",")
                bases += [b.split()[-1] if report.language == "cpp" else b.strip() for b in parts if b.strip()]
        report.klass(name, line(at), line(max(start, end - 1)), outer[2] if outer else None, bases)
    for m in re.finditer(syn.imports, with_strings):
        target = re.sub(r"^use\s+|\s+$", "", m[1]) if report.language == "rust" else m[1].strip("<>\"") if report.language in ("c", "cpp") else m[1]
        report.imports(target, line(m.start(1)))
        if report.language in ("javascript", "typescript", "tsx"):
            names = re.sub(r"^import\s*(type\s+)?|\bfrom\b.*$", "", m.group(), flags=re.DOTALL)
            for part in re.split(r"[{},]", names):
                if part.strip():
                    report.imported[part.split()[-1]] = m[1]
    spans = []
    for start, end, name, cls in functions:
        params = re.compile(r"\([^()]*(?:\([^()]*\)[^()]*)*\)").match(code, code.find("(", start)) if "(" in code[start : start + 200] else None
        result = RETURNS[report.language].match(code, params.end()) if params and report.language in RETURNS else None
        q = report.function(name, line(start), line(max(start, end - 1)), cls, params=params.group() if params else None, return_type=result[1].strip() if result else None)
        spans.append((start, end, q))
    if report.language == "solidity":
        solidity.extend(report, code, line, classes, spans)
    for m in re.finditer(syn.calls, code):
        name = next(g for g in m.groups() if g)
        at = m.start(m.groups().index(name) + 1)
        around = [s for s in spans if s[0] < at < s[1]]
        if around and at not in taken and name not in _NOT_CALLS:
            report.call(around[-1][2], name, line(at))
