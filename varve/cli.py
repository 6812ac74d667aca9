"""Command line: check pipelines, list and describe actions."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans.check import check
from .registry import packs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="varve")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("check", help="check pipeline files without running them")
    one.add_argument("files", nargs="+")
    sub.add_parser("list", help="list packs")
    two = sub.add_parser("catalog", help="list the actions of packs")
    two.add_argument("packs", nargs="*")
    three = sub.add_parser("spec", help="describe an action")
    three.add_argument("action")
    args = parser.parse_args(argv)
    if args.command == "check":
        bad = 0
        for name in args.files:
            report = check(Path(name).read_text())
            for d in report.diagnostics:
                print(f"{name}: {d}")
            for n, o in report.outputs.items():
                shape = "deferred" if o.shape is None else list(o.shape)
                print(f"{name}: {n or 'output'}: {o.kind} {o.dtype or ''} {shape}")
            bad += not report.ok
        return int(bad > 0)
    if args.command == "list":
        print("\n".join(sorted(packs())))
    elif args.command == "catalog":
        for p in args.packs or sorted(packs()):
            print(f"{p}: {' '.join(sorted(packs()[p]))}")
    else:
        pack, _, name = args.action.rpartition("/")
        hits = [a for p, acts in packs().items() for n, a in acts.items() if n == name and pack in ("", p)]
        if not hits:
            print(f"unknown action {args.action}", file=sys.stderr)
            return 1
        for a in hits:
            print(f"{a.path}: takes {', '.join(sorted(a.kinds))}" + (f"\n{a.doc}" if a.doc else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
