"""Review one document at the terminal: prompts on stderr, the result on stdout or in a file."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from . import apply_choices
from .errors import ReviewError
from .operators import review
from .sources.lexicon import Lexicon

USAGE, FAILED = 2, 1


def run_session(text: str, lexicon: Lexicon | None = None, *, read: Callable[[], str] = input, err: TextIO | None = None) -> tuple[str, int]:
    """The revised text and 0, or 130 if interrupted (what was chosen before is applied)."""
    from pyspark.sql import functions as F

    from .operators.suggest import suggest
    from .session import get_session
    from .sources.texts import from_texts

    err = err or sys.stderr
    spark = get_session()
    found = suggest(from_texts(spark, [text]), lexicon, context=True)
    shown = review.prompt(F.col("sentence"), F.col("start") - F.col("win_start"), F.col("end") - F.col("win_start"), F.col("alternatives"), F.lit(-1), color="NO_COLOR" not in os.environ)
    session = review.Session(list(review.fetch(found.withColumn("prompt", shown))))
    code = review.DONE
    try:
        while (m := session.current) is not None:
            err.write(_marked(m, session.default()))
            err.flush()
            message = session.answer(review.typed(read()))
            if message:
                err.write(message)
                err.flush()
    except KeyboardInterrupt:
        code = review.INTERRUPTED
    return apply_choices(text, [((a, b), t) for a, b, t in session.choices]), code


def _marked(m: dict, default: int | None) -> str:
    """The prompt with the remembered option marked."""
    if default is None:
        return m["prompt"]
    lines = m["prompt"][:-1].split("\n")
    at = len(lines) - len(m["alternatives"]) - 1 + default
    lines[at] += " [default]"
    return "\n".join(lines) + "\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossa", description="Review a document's vocabulary.")
    p.add_argument("text", nargs="?", metavar="TEXT", help="the text itself")
    p.add_argument("-f", "--file", type=Path, metavar="PATH", help="read the document from a file")
    to = p.add_mutually_exclusive_group()
    to.add_argument("-o", "--output", type=Path, metavar="PATH", help="write the result to a file")
    to.add_argument("--in-place", action="store_true", help="write the result to the input file")
    return p


def _misused(args: argparse.Namespace) -> str | None:
    if args.text is not None and args.file is not None:
        return "TEXT and -f/--file are mutually exclusive"
    if args.text is None and args.file is None:
        return "supply TEXT or -f/--file"
    if args.in_place and args.file is None:
        return "--in-place requires -f/--file"
    return None if sys.stdin.isatty() else "an interactive terminal is needed (stdin is not a tty)"


def _fail(message: str, code: int) -> int:
    print(f"error: {message}", file=sys.stderr)
    return code


#: What is said of a file that cannot be read or written; the first kind that fits.
READING = {
    FileNotFoundError: "file not found: {path}",
    IsADirectoryError: "{path} is a directory",
    PermissionError: "permission denied: {path}",
    UnicodeDecodeError: "{path}: cannot decode as {e.encoding}: {e.reason}",
}
WRITING = {PermissionError: "cannot write to {path}: permission denied"}


class _Failed(Exception):
    """A message for the person at the terminal."""


def _try(messages: dict[type[Exception], str], path: Path, action: Callable[[], str | int]) -> str | int:
    try:
        return action()
    except tuple(messages) as e:
        raise _Failed(next(m for kind, m in messages.items() if isinstance(e, kind)).format(path=path, e=e)) from e


def _review(args: argparse.Namespace) -> int:
    """Read, review and write one document."""
    source = args.file
    text = args.text if source is None else _try(READING, source, lambda: source.read_text(encoding="utf-8"))
    revised, code = run_session(text)
    target = source if args.in_place else args.output
    if target is None:
        sys.stdout.write(revised)
    else:
        _try(WRITING, target, lambda: target.write_text(revised, encoding="utf-8"))
    return code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if (wrong := _misused(args)) is not None:
        return _fail(wrong, USAGE)
    try:
        return _review(args)
    except (_Failed, ReviewError) as e:
        return _fail(str(e), FAILED)


if __name__ == "__main__":
    sys.exit(main())
