"""What an extractor reports about one file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import TEST_NAME

_TEST = re.compile(TEST_NAME)


@dataclass
class Report:
    """Rows of one file. Edges are (kind, source, target, line, module): where ``module`` is set, ``target`` is a name imported
    from it and still has to be resolved against the other files."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str, int, str | None]] = field(default_factory=list)
    defined: set[str] = field(default_factory=set)  #: names defined at the top level
    imported: dict[str, str] = field(default_factory=dict)  #: local name -> module

    def qualified(self, name: str, parent: str | None = None) -> str:
        return f"{self.path}::{parent}.{name}" if parent else f"{self.path}::{name}"

    def node(self, kind: str, name: str, first: int, last: int, parent: str | None = None, **more) -> str:
        q = self.path if kind == "File" else self.qualified(name, parent)
        row = {"kind": kind, "name": name, "qualified_name": q, "line_start": first, "line_end": last, "parent_name": parent, "is_test": kind == "Test"}
        self.nodes.append({"params": None, "return_type": None, "modifiers": None, "extra": {}} | row | more)
        return q

    def file(self, text: str) -> None:
        self.node("File", self.path, 1, text.count("\n") + 1)

    def klass(self, name: str, first: int, last: int, parent: str | None, bases: list[str], **more) -> None:
        """A class; its container is the file even when it is nested."""
        q = self.node("Class", name, first, last, parent, **more)
        self.edges.append(("CONTAINS", self.path, q, first, None))
        for b in bases:
            self.edges.append(("INHERITS", q, b, first, None))

    def function(self, name: str, first: int, last: int, parent: str | None, **more) -> str:
        q = self.node("Test" if _TEST.search(name) else "Function", name, first, last, parent, **more)
        self.edges.append(("CONTAINS", self.qualified(parent) if parent else self.path, q, first, None))
        return q

    def imports(self, target: str, line: int) -> None:
        self.edges.append(("IMPORTS_FROM", self.path, target, line, None))

    def call(self, source: str, name: str, line: int) -> None:
        """A call by bare name: to a name of this file, to an imported one, or to a name that stays bare."""
        if name in self.defined:
            self.edges.append(("CALLS", source, self.qualified(name), line, None))
        else:
            self.edges.append(("CALLS", source, name, line, self.imported.get(name)))
