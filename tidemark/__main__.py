"""A small shell: SQL until a semicolon, and the commands \\load, \\dt, \\explain, \\q."""

from __future__ import annotations

import argparse
import contextlib
import sys
import time
from collections.abc import Iterator
from pathlib import Path

from tidemark.plans.engine import Engine
from tidemark.plans.render import table_text
from tidemark.session import local_session


def command(engine: Engine, line: str) -> str:
    """Run one backslash command and return what it prints."""
    word, _, rest = line.strip().rstrip(";").partition(" ")
    if word == "\\dt":
        return table_text(engine.tables())
    if word == "\\explain":
        return engine.explain(rest)
    if word == "\\load":
        kind, name, path = rest.split(None, 2)
        if kind not in ("csv", "parquet"):
            return f"unknown kind of table: {kind}"
        (engine.register_csv if kind == "csv" else engine.register_parquet)(name, path)
        return f"loaded {name}"
    return "commands: \\load csv|parquet NAME PATH, \\dt, \\explain QUERY, \\q"


def interactive(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    waiting: list[str] = []
    for line in lines:
        if not waiting and line.startswith("\\"):
            if line.strip() == "\\q":
                return
            try:
                print(command(engine, line), file=out)
            except Exception as e:  # a shell goes on after an error
                print(f"error: {e}", file=out)
            continue
        waiting.append(line)
        if line.rstrip().endswith(";"):
            began = time.monotonic()
            try:
                for df in engine.run("".join(waiting)):
                    print(table_text(df), file=out)
                print(f"{time.monotonic() - began:.3f} s", file=out)
            except Exception as e:
                print(f"error: {e}", file=out)
            waiting = []


def typed(history: Path) -> Iterator[str]:
    """Lines typed at a prompt; where the terminal allows it with a history that outlasts the session."""
    try:
        import readline
    except ImportError:
        readline = None
    if readline:
        with contextlib.suppress(OSError):
            readline.read_history_file(history)
    try:
        while True:
            yield input("tidemark> ") + "\n"
    except EOFError:
        return
    finally:
        if readline:
            readline.set_history_length(1_000)
            with contextlib.suppress(OSError):
                readline.write_history_file(history)


def main() -> None:
    args = argparse.ArgumentParser(prog="tidemark")
    args.add_argument("--location", help="folder for created tables")
    with Engine(local_session(), location=args.parse_args().location) as engine:
        interactive(engine, typed(Path.home() / ".tidemark_history") if sys.stdin.isatty() else sys.stdin)


if __name__ == "__main__":
    main()
