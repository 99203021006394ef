"""Commands: ``python -m lumenseek.cli ingest FOLDER``, ``ask QUESTION ...`` (or a console on standard input), ``watch FOLDER``,
``compact``, ``vacuum``, ``health``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .config import Settings, load_settings
from .plans.engine import Engine, NothingIngested, StaleEntries
from .plans.session import session
from .sources.store import AGE_S, RETAINED


#: Lines that end the console. Fixed values.
QUIT = ("quit", "exit", "q")


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenseek")
    out.add_argument("--state", default="lumenseek-state", help="folder of the stored state")
    out.add_argument("--settings", help="TOML file")
    out.add_argument("--sample", help="TOML file that a missing settings file is made from")
    commands = out.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read new files of a folder")
    ingest.add_argument("folder")
    ingest.add_argument("--fresh", action="store_true", help="discard what is stored")
    ingest.add_argument("--no-recurse", action="store_true", help="only files of the folder itself")
    ingest.add_argument("--filetypes", help="extensions to read, separated by commas")
    ingest.add_argument("--on-stale", choices=("fail", "fresh", "clean", "append"), default="append", help="what to do about files that are gone")
    ingest.add_argument("--verbose", action="store_true", help="also print why files were skipped or failed")
    ask = commands.add_parser("ask", help="answer questions")
    ask.add_argument("question", nargs="*")
    ask.add_argument("-k", type=int)
    ask.add_argument("--json", action="store_true")
    watch = commands.add_parser("watch", help="take the files that have arrived in a folder, as a stream")
    watch.add_argument("folder")
    watch.add_argument("--checkpoint", required=True, help="folder of the stream's own state")
    watch.add_argument("--stay", action="store_true", help="go on waiting for files")
    commands.add_parser("compact", help="write all tables anew, without what is deleted")
    vacuum = commands.add_parser("vacuum", help="delete manifests and parts that nothing needs any more")
    vacuum.add_argument("--retain", type=int, default=RETAINED, help="manifests that stay")
    vacuum.add_argument("--hours", type=float, default=AGE_S / 3600, help="what is younger stays")
    commands.add_parser("health")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, **providers) -> int:
    """Runs a command; ``providers`` (embedder, extractor, model, reranker) go to the engine."""
    args = _parser().parse_args(argv)
    settings = load_settings(args.settings, args.sample) if args.settings else Settings()
    engine = Engine(spark or session(), args.state, settings, **providers)
    try:
        run = {"ingest": _ingest, "ask": _ask, "watch": _watch, "compact": lambda e, a: e.compact() or 0, "vacuum": _vacuum, "health": lambda e, a: print(json.dumps(e.health())) or 0}
        return run[args.command](engine, args)
    except (NothingIngested, StaleEntries, FileNotFoundError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _vacuum(engine: Engine, args: argparse.Namespace) -> int:
    print(f"deleted: {len(engine.store.vacuum(args.retain, args.hours * 3600))}")
    return 0


def _watch(engine: Engine, args: argparse.Namespace) -> int:
    engine.watch(args.folder, args.checkpoint, once=not args.stay).awaitTermination()
    print(json.dumps(engine.health()))
    return 0


def _ingest(engine: Engine, args: argparse.Namespace) -> int:
    if args.verbose:
        engine.progress = lambda stage, rows: print(f"  {stage}: {rows}", file=sys.stderr)
    report = engine.ingest(args.folder, not args.no_recurse, args.filetypes, args.fresh, args.on_stale)
    counters = report.counters.first().asDict()
    print(", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in counters.items()) + f", new chunks: {report.n_chunks}")
    if args.verbose:
        for r in report.skipped.collect():
            print(f"  {r.reason}: {r.n}")
        for r in report.errors.select("path", "error", "message").orderBy("path").toLocalIterator():
            print(f"  {r.path}: {r.error}: {r.message}")
    return 0


def _typed() -> Iterator[str]:
    """Lines of standard input up to a word that ends the console; a terminal is asked for them."""
    while True:
        if sys.stdin.isatty():
            print("question> ", end="", flush=True)
        line = sys.stdin.readline()
        if not line or line.strip().lower() in QUIT:
            return
        yield line.strip()


def _ask(engine: Engine, args: argparse.Namespace) -> int:
    engine.validate()
    for question in args.question or _typed():
        if not question:
            continue
        try:
            answers = engine.answer([question], args.k)
        except (PySparkException, Py4JJavaError) as e:
            if args.question:
                raise
            print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)  # the console goes on
            continue
        for found in answers:
            print(json.dumps(found, ensure_ascii=False) if args.json else "\n".join([found["answer"], *(f"  {s}" for s in found["sources"])]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
