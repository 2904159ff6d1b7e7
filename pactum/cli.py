"""Command line: extract files, list fields, print the schema, show a demo. A bare path is extracted.

Exit codes: 0 found something (also where the reader of a pipe went away), 1 low signal in every
document, 2 a user's error, 130 interrupted. Records go to stdout, everything else to stderr.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from pactum import __version__
from pactum.operators import enrich, records, sinks
from pactum.sources import files

DEMO = """# Services Agreement

This Agreement is entered into by and between Alder Works LLC (the "Client") and Birch Labs Inc (the "Provider"), effective as of 2024-05-01.

## Confidentiality
Each party keeps what it learns secret.

## Term
The initial term of this Agreement is two (2) years. It shall automatically renew for successive one-year periods.

## Governing Law
This Agreement is governed by the laws of the State of Delaware. The fee is $12,000.

By: Ann Alder
Title: Director
"""
LOW_SIGNAL = "no parties, clauses, dates, law or terms were found; the file may be scanned, an image or without structure"
EXIT_CODES = {"0": "ok", "1": "low signal in every document", "2": "user error", "130": "interrupted"}
_COLORS = {"red": "31", "yellow": "33", "green": "32"}


class UserError(Exception):
    """What the user can mend; exit code 2."""


def colored(text: str, color: str, stream: object) -> str:
    """Text in color where the stream is a terminal; NO_COLOR and FORCE_COLOR decide first."""
    wanted = not os.environ.get("NO_COLOR") and (bool(os.environ.get("FORCE_COLOR")) or getattr(stream, "isatty", bool)())
    return f"\033[{_COLORS[color]}m{text}\033[0m" if wanted else text


def _say(text: str, kind: str = "", color: str = "yellow") -> None:
    print((colored(f"{kind}: ", color, sys.stderr) if kind else "") + text, file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pactum", description="Contract documents to typed rows")
    top.add_argument("-V", "--version", action="version", version=f"pactum {__version__}")
    top.add_argument("--no-color", action="store_true", help="no color, wherever the flag stands")
    top.add_argument("--catalog", metavar="json", help="commands, flags and exit codes as JSON")
    commands = top.add_subparsers(dest="command")
    output = argparse.ArgumentParser(add_help=False)
    output.add_argument("--json", action="store_true", help="JSON, whatever --format says")
    output.add_argument("--format", choices=("json", "table"), default="json")
    output.add_argument("--no-confidence", action="store_true", help="values only")
    output.add_argument("--why", action="store_true", help="say on stderr what was found and how")
    output.add_argument("-q", "--silent", "--quiet", dest="silent", action="store_true", help="no warnings and no tables; JSON stays")
    one = commands.add_parser("extract", parents=[output], help="records of files, a folder or a pattern")
    one.add_argument("path")
    one.add_argument("--fields", default="", help="comma-separated names of fields")
    one.add_argument("--llm", action="store_true", help="fill gaps with a language model, as the user's configuration says")
    one.add_argument("--out", help="write JSON lines to this folder instead of printing")
    commands.add_parser("schema", help="JSON Schema of records")
    commands.add_parser("fields", help="the fields of a record").add_argument("--json", action="store_true", help="as JSON")
    demo = commands.add_parser("demo", parents=[output], help="a bundled document")
    demo.add_argument("--fields", default="", help=argparse.SUPPRESS)
    demo.add_argument("--llm", action="store_true", help=argparse.SUPPRESS)
    commands.add_parser("catalog", help="commands as JSON")
    commands.add_parser("completion", help="a script of completions for a shell").add_argument("shell", choices=("bash", "zsh"))
    return top


def _commands() -> dict[str, argparse.ArgumentParser]:
    return next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices


def catalog() -> dict:
    """What the command line takes, read off the parser."""
    helps = {a.dest: a.help for a in next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction))._choices_actions}
    plain = lambda a: isinstance(a, argparse._StoreTrueAction)

    def flags(p: argparse.ArgumentParser) -> Iterator[dict]:
        for a in p._actions:
            if a.option_strings and a.dest != "help" and a.help != argparse.SUPPRESS:
                long = next(o for o in a.option_strings if o.startswith("--"))
                yield {"name": long, "aliases": [o for o in a.option_strings if o != long], "help": a.help or "", "required": a.required, "default": None if plain(a) else a.default, "choices": list(a.choices) if a.choices else None}

    commands = [{"name": k, "help": helps[k], "flags": list(flags(p))} for k, p in _commands().items()]
    return {"name": "pactum", "bin": "pactum", "version": __version__, "description": parser().description, "commands": commands, "exitCodes": EXIT_CODES}


def completion(shell: str) -> str:
    """A script that completes commands, flags and paths; it asks the program itself."""
    ask = 'python -m pactum.cli __complete'
    if shell == "bash":
        return f'_pactum() {{ COMPREPLY=($(compgen -f -W "$({ask} "${{COMP_WORDS[1]}}")" -- "${{COMP_WORDS[COMP_CWORD]}}")); }}\ncomplete -F _pactum pactum\n'
    return f'_pactum() {{ compadd -- $({ask} "$words[2]"); _files; }}\ncompdef _pactum pactum\n'


def _completions(command: str) -> list[str]:
    """Commands, and the flags of one of them (those of extract for a path)."""
    of = _commands().get(command, _commands()["extract"])
    return [*_commands(), *[o for a in of._actions for o in a.option_strings if a.help != argparse.SUPPRESS]]


def _routed(argv: list[str]) -> list[str]:
    """Flags that stand anywhere first; a path without a command is extracted."""
    if "--no-color" in argv:
        os.environ["NO_COLOR"] = "1"
        argv = [a for a in argv if a != "--no-color"]
    for i, a in enumerate(argv):
        if a.split("=")[0] == "--catalog":
            wanted = a.partition("=")[2] or (argv[i + 1] if a == "--catalog" and i + 1 < len(argv) else "json")
            if wanted != "json":
                raise UserError(f"unknown form of the catalog: {wanted} (json)")
            return ["catalog"]
    return argv if not argv or argv[0] in (*_commands(), "-h", "--help", "-V", "--version", "__complete") else ["extract", *argv]


def _enriched(found: DataFrame, silent: bool) -> DataFrame:
    """Records with what a language model adds; without a configuration they stay as they are."""
    settings = enrich.config()
    if settings is None:
        if not silent:
            _say("no configuration of a language model; nothing is asked", "warning")
        return found.drop("text")
    asked = found.select("path", enrich.prompt(F.col("text"), F.size("clauses") > 0).alias("prompt"))
    merged = enrich.merge(found.join(enrich.replies(asked, enrich.client(settings), "path"), "path", "left"))
    merged = merged.withColumn("warnings", F.filter(F.concat("warnings", F.array(F.concat(F.lit("language model: "), F.col("warning")))), lambda w: w.isNotNull()))
    low = records.low_signal(F.col("parties"), F.col("clauses"), F.col("dates.effective"), F.col("governing_law"), F.col("defined_terms"))
    return merged.drop("warning").withColumn("low_signal", low)


def _explain(row: Row, args: argparse.Namespace) -> None:
    """Problems and reasons of one document, on stderr."""
    if row.error:
        return _say(f"{row.path}: {row.error}", "error", "red")
    if not args.silent:
        for w in row.warnings or []:
            _say(f"{row.path}: {w}", "warning")
    if args.why:
        _say(f"\n[why] {row.path}\n  format={row.format} parties={row.n_parties} clauses={row.n_clauses}\n  tiers={','.join(row.tiers)} llm_used={row.llm_used}\n  low_signal={row.low_signal}")
    if row.low_signal and not args.silent:
        _say(f"{row.path}: {LOW_SIGNAL}", "warning")
    return None


def _extract(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "demo":
        docs = spark.createDataFrame([("demo.md", DEMO)], "path string, text string").select("*", F.lit("markdown").alias("format"), F.sha2("text", 256).alias("sha256"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("error"))
    else:
        try:
            docs = files.scan(spark, args.path)
        except Exception as e:  # noqa: BLE001  a path that can't be listed is the user's error
            raise UserError(str(e).splitlines()[0]) from e
    found = records.extract(docs, keep=("path", "text", "warnings", "error"))
    found = _enriched(found, args.silent) if args.llm and args.command == "extract" else found.drop("text")
    if args.command == "demo" and not args.silent:
        _say("A bundled contract, read without a model or a network; try: demo --format table")
    wanted = [f for f in args.fields.split(",") if f] if args.command == "extract" else []
    if getattr(args, "out", None):
        seen = Observation("documents")
        kept = found.observe(seen, F.count(F.when(~F.col("low_signal") & F.col("error").isNull(), 1)).alias("good"), F.count(F.col("error")).alias("failed"))
        shown = records.project(kept, wanted)
        sinks.write_json(records.strip_confidence(shown) if args.no_confidence else shown, args.out)
        if seen.get["failed"]:
            _say(f"{seen.get['failed']} files could not be read", "error", "red")
        return 0 if seen.get["good"] else 1
    rows = failed = good = 0
    for row in sinks.printable(found, wanted, args.no_confidence, args.format == "table" and not args.json).toLocalIterator():
        rows, failed, good = rows + 1, failed + bool(row.error), good + (not row.error and not row.low_signal)
        _explain(row, args)
        if not row.error and row.j is not None:
            print(json.dumps(json.loads(row.j), indent=2))
        elif not row.error and (not args.silent or args.command == "demo"):
            print(sinks.table(row.record), end="\n\n")
    if not rows:
        raise UserError(f"no file at {args.path}")
    return 2 if failed == rows else 0 if good or args.command == "demo" else 1


def _run(argv: list[str]) -> int:
    argv = _routed(argv)
    if argv[:1] == ["__complete"]:
        print("\n".join(_completions(argv[1] if len(argv) > 1 else "")))
        return 0
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
    elif args.command == "catalog":
        print(json.dumps(catalog(), indent=2))
    elif args.command == "completion":
        print(completion(args.shell), end="")
    elif args.command == "schema":
        print(sinks.json_schema())
    elif args.command == "fields" and args.json:
        print(json.dumps([dict(zip(("field", "tier", "description"), f, strict=True)) for f in enrich.FIELD_CATALOG], indent=2))
    elif args.command == "fields":
        for name, tier, text in enrich.FIELD_CATALOG:
            print(f"{name:<28}{colored(f'{tier:<16}', 'green' if tier == 'deterministic' else 'yellow', sys.stdout)}{text}")
    else:
        return _extract(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
    return 0


def main(argv: list[str] | None = None) -> int:
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    try:
        code = _run(sys.argv[1:] if argv is None else argv)
        sys.stdout.flush()
        return code
    except UserError as e:
        _say(str(e), "error", "red")
        return 2
    except BrokenPipeError:
        # what is still buffered goes nowhere, so that the interpreter ends quietly
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except KeyboardInterrupt:
        _say("interrupted")
        return 130


if __name__ == "__main__":
    sys.exit(main())
