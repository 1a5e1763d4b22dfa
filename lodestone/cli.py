"""Command line: `python -m lodestone.cli forensics|rank|schema|payload ...`."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from lodestone.operators import forensics, ranking
from lodestone.plans import schema
from lodestone.sources import files

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def logger(name: str = "lodestone", level: str = "INFO") -> logging.Logger:
    """One handler, however often it is asked for; unknown levels are INFO."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level.upper() if level.upper() in LEVELS else "INFO")
    return log


def compact(payload: dict) -> str:
    """JSON with a line per field."""
    lines = ["{"]
    for i, (name, body) in enumerate(payload.items()):
        head = {k: v for k, v in body.items() if k != "fields"}
        lines += [f"  {json.dumps(name)}: {{", *[f"    {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}," for k, v in head.items()], '    "fields": {']
        items = list(body["fields"].items())
        lines += [f"      {json.dumps(f)}: {json.dumps(s, ensure_ascii=False)}{',' if j + 1 < len(items) else ''}" for j, (f, s) in enumerate(items)]
        lines += ["    }", f"  }}{',' if i + 1 < len(payload) else ''}"]
    return "\n".join([*lines, "}"]) + "\n"


def with_defaults(payload: dict) -> dict:
    """Definitions with a description and bases, empty ones if there are none."""
    return {name: {"class_description": "", "base_classes": ["BaseModel"], **body} for name, body in schema.validate(payload).items()}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lodestone").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("--log-level", default="INFO")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("forensics", help="assess the files of a folder")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--form", default="json", choices=("json", "txt"))
    p = commands.add_parser("rank", help="rank candidates for a query record")
    p.add_argument("query")
    p.add_argument("candidates")
    p.add_argument("out")
    p.add_argument("--top", type=int, default=ranking.TOP_N)
    p = commands.add_parser("schema", help="schema payload (JSON) to source")
    p.add_argument("payload")
    p.add_argument("out")
    p.add_argument("--round-trip", action="store_true")
    p = commands.add_parser("payload", help="source to schema payload (JSON)")
    p.add_argument("source")
    p.add_argument("out")
    given = parser.parse_args(args)
    log = logger(level=given.log_level)
    if given.command == "schema":
        payload = with_defaults(json.loads(Path(given.payload).read_text()))
        if given.round_trip and not schema.round_trips(payload):
            log.error("the round trip changes the payload")
            return 1
        Path(given.out).write_text(schema.emit(payload))
    elif given.command == "payload":
        Path(given.out).write_text(compact(schema.read_source(Path(given.source).read_text())))
    elif given.command == "forensics":
        files.write_report(forensics.analyze(files.files(session(), given.path).select("path", "content")), given.out, given.form)
    else:
        from pyspark.sql import functions as F

        spark = session()
        candidates = files.candidates_json(spark, given.candidates)
        query = files.query_json(spark, given.query).withColumn("query_id", F.lit("query"))
        files.write_ranking(ranking.response(ranking.rank(query, candidates, given.top), candidates), given.out)
    log.info("written: %s", given.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
