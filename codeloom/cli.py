"""Command line: ``python -m codeloom.cli serve|update|watch``."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .session import GraphSession, create_session
from .sources.files import find_project_root


def serve(session: GraphSession, lines=sys.stdin, out=sys.stdout) -> None:
    """One JSON request a line, ``{"tool": "graph", "action": ..., ...}``, and one JSON answer a line."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            tool = request.pop("tool", "graph")
            if tool == "help":
                result = session.help(**request)
            elif tool in ("graph", "config"):
                result = getattr(session, tool)(**request)
            else:
                result = {"error": f"Unknown tool: {tool}", "valid_tools": ["graph", "config", "help"]}
        except (ValueError, TypeError) as e:
            result = {"error": str(e)}
        print(json.dumps(result, default=str), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command")
    for name, says in (("serve", "answer requests on standard input"), ("update", "update the graph from git"), ("watch", "follow changes that arrive in a folder")):
        p = sub.add_parser(name, help=says)
        p.add_argument("--repo", default=None)
        if name == "update":
            p.add_argument("--base", default="HEAD~1")
        if name == "watch":
            p.add_argument("folder")
            p.add_argument("checkpoint")
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 0
    session = GraphSession(create_session(), str(args.repo or find_project_root()))
    if args.command == "serve":
        serve(session)
    elif args.command == "watch":
        session.watch(args.folder, args.checkpoint).awaitTermination()
    else:
        result = session.graph("update", base=args.base)
        print(result["summary"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
