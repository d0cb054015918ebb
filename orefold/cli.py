"""python -m orefold.cli analyze PATH --output DIR | list-metrics | explain ID | validate-output DIR | score DIR PROFILE"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from orefold.catalog import METRICS, find

OK, INPUT_ERROR, INVALID, REJECTED = 0, 1, 2, 3
VERSION = "orefold 0.2.0"


def _glob(text: str) -> str:
    if not text.strip():
        raise argparse.ArgumentTypeError("a glob must not be empty")
    return text


def _count(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError("a number of 0 or more is needed")
    return int(text)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        """Wrong arguments are an input error like any other."""
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise SystemExit(INPUT_ERROR)


def main(argv: list[str] | None = None) -> int:
    parser = _Parser(prog="orefold", description=__doc__)
    parser.add_argument("--version", action="version", version=VERSION)
    verbs = parser.add_subparsers(dest="verb", required=True)
    analyze = verbs.add_parser("analyze")
    analyze.add_argument("path")
    analyze.add_argument("--output", "-o", required=True)
    analyze.add_argument("--top", type=_count, default=20)
    analyze.add_argument("--include", type=_glob, action="append", default=[])
    analyze.add_argument("--exclude", type=_glob, action="append", default=[])
    analyze.add_argument("--include-generated", action="store_true")
    analyze.add_argument("--include-chunk-text", action="store_true")
    analyze.add_argument("--syntax-only", action="store_true", help="what is done anyway: text alone is read")
    analyze.add_argument("--semantic", action="store_true", help="an error: binding needs a compiler, so semantic facts have to be ingested")
    analyze.add_argument("--no-restore", action="store_true", help="noted in the manifest; nothing is ever restored")
    analyze.add_argument("--isolate-input", action="store_true")
    analyze.add_argument("--allow-degraded", action="store_true")
    analyze.add_argument("--allow-empty", action="store_true")
    verbs.add_parser("help")
    verbs.add_parser("list-metrics")
    verbs.add_parser("explain").add_argument("metric")
    verbs.add_parser("validate-output").add_argument("folder")
    score = verbs.add_parser("score")
    score.add_argument("folder")
    score.add_argument("profile")
    args = parser.parse_args(argv)
    if args.verb == "list-metrics":
        for m in sorted(METRICS, key=lambda m: m.id):
            print(f"{m.id}@{m.version}\t{','.join(m.target_kinds)}\t{m.unit}")
        return OK
    if args.verb == "explain":
        m = find(args.metric)
        if m is None:
            print(f"unknown metric: {args.metric}", file=sys.stderr)
            return INPUT_ERROR
        print(f"{m.id}@{m.version}\nTarget kinds: {', '.join(m.target_kinds)}\nUnit: {m.unit}\nFormula: {m.formula}")
        return OK
    if args.verb == "help":
        parser.print_help()
        return OK
    if args.verb == "analyze" and args.semantic and not args.syntax_only:
        print("semantic facts can't be computed from text; ingest them (schemas.py) or use --syntax-only", file=sys.stderr)
        return INPUT_ERROR
    from orefold.engine import Engine
    from orefold.runtime import build_session

    engine = Engine(build_session())
    try:
        if args.verb == "analyze":
            summary = engine.run(args.path, args.output, args.top, args.include_chunk_text, args.isolate_input, args.no_restore, include=args.include, exclude=args.exclude, generated=args.include_generated)
            print(json.dumps(summary, indent=2))
            return OK if engine.accepted(summary, args.allow_degraded, args.allow_empty) else REJECTED
        if args.verb == "validate-output":
            problems = engine.validate(args.folder)
            problems.show(100, truncate=False)
            return OK if problems.limit(1).count() == 0 else INVALID
        print(json.dumps(engine.score(args.folder, Path(args.profile).read_text(encoding="utf-8")), indent=2))
        return OK
    except ValueError as e:
        print(e, file=sys.stderr)
        return INPUT_ERROR


if __name__ == "__main__":
    sys.exit(main())
