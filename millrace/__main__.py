"""Command line: check, run, watch, schema and reclaim for pipelines described in a document.

Exit codes: 0 done, 2 a wrong command or document, 3 a frozen schema was violated, 4 a source or destination
failed, 5 a value can't be held, 6 cancelled.
"""

from __future__ import annotations

import argparse
import json
import signal
import sys
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from millrace.operators.infer import Limit
from millrace.operators.passthrough import InexactCast
from millrace.operators.policy import ContractViolation
from millrace.plans.report import Metrics, ndjson
from millrace.plans.validate import ConfigError
from millrace.sources.base import SourceError
from millrace.sources.files import JsonLines, TypedFiles
from millrace.sources.store import SnapshotStore
from millrace.streaming.engine import Cancelled, Pipeline

# The exit codes.
DONE, USAGE, VIOLATED, FAILED, UNFIT, STOPPED = 0, 2, 3, 4, 5, 6

SOURCES: dict[str, Callable[..., Any]] = {"jsonl": JsonLines, "files": TypedFiles}
DESTINATIONS: dict[str, Callable[..., Any]] = {"store": SnapshotStore}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Moves data into managed tables.")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("check", "reach both ends, move nothing"), ("run", "run to the end of all streams"), ("watch", "run, with a line of JSON for each event"), ("schema", "print the tables of the destination"), ("reclaim", "replay or drop what a dead run left")):
        c = commands.add_parser(name, help=text)
        c.add_argument("document", help="pipeline document (YAML or JSON)")
        c.add_argument("--master", help="Spark master; default: the environment's, or local")
    return p


def _session(master: str | None):
    from millrace.session import local_session

    if master is None or master.startswith("local"):
        return local_session("*")
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(master).getOrCreate()


def act(args: argparse.Namespace, out: Any = sys.stdout, spark: Any = None) -> int:
    """One command; returns its exit code."""
    try:
        with open(args.document, encoding="utf-8") as f:
            pipeline = Pipeline.from_document(f.read(), SOURCES, DESTINATIONS)
        if args.command == "schema":
            for t in pipeline.destination.tables():
                print(json.dumps({"table": t, "columns": [[f.name, f.dataType.simpleString()] for f in pipeline.destination.schema(t)]}), file=out)
            return DONE
        if args.command == "reclaim":
            with pipeline.destination.session(pipeline.name) as s:
                print(json.dumps({"recovered": s.recovered}), file=out)
            return DONE
        spark = spark or _session(args.master)
        if args.command == "check":
            pipeline.check(spark)
            return DONE
        metrics = Metrics()
        pipeline.listeners += [metrics, *([ndjson(out)] if args.command == "watch" else [])]
        before = signal.signal(signal.SIGINT, lambda *_: pipeline.cancel())
        try:
            report = pipeline.run(spark)
        finally:
            signal.signal(signal.SIGINT, before)
        print(json.dumps({"report": asdict(report), "rows_a_second": round(report.rate, 1) if hasattr(report, "rate") and not callable(report.rate) else None}, default=str), file=out)
        return DONE
    except (ConfigError, OSError) as e:
        return _said(e, USAGE)
    except ContractViolation as e:
        return _said(e, VIOLATED)
    except Cancelled as e:
        return _said(e, STOPPED)
    except (InexactCast, Limit) as e:
        return _said(e, UNFIT)
    except SourceError as e:
        return _said(e, FAILED)


def _said(e: BaseException, code: int) -> int:
    print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(act(parser().parse_args()))
