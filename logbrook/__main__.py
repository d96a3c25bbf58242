"""Commands: capture, preview, inspect, verify, prepare, redact-test.  Each ends with an exit code of errors.EXIT."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import EXIT, ConfirmationError, Failure, PolicyError, SchemaError, SourceError, UsageError
from .functions.patterns import Registry
from .functions.redact import redact
from .operators import incidents, report
from .plans import capture as plans
from .plans.workspace import prepare


def _spark() -> SparkSession:
    return SparkSession.builder.appName("logbrook").config("spark.ui.enabled", "false").getOrCreate()


def _registry(policy: str | None) -> Registry | None:
    return Registry.from_policy(Path(policy).read_text(encoding="utf-8").splitlines()) if policy else None


def _told(rows, as_json: bool) -> None:
    for row in rows:
        print(json.dumps(row.asDict(True), default=str) if as_json else "  ".join(f"{k}={v}" for k, v in row.asDict(True).items()))


def _capture(args) -> int:
    spark = _spark()
    if not args.yes:
        raise ConfirmationError("capture writes a bundle; confirm with --yes after looking at preview")
    incident = None
    if args.incident:
        text = Path(args.incident).read_text(encoding="utf-8") if Path(args.incident).is_file() else None
        code = spark.createDataFrame([(text,)], "value string").select(incidents.gate(F.col("value")).alias("c")).first().c
        if code:
            raise (SchemaError if code == "E_SCHEMA_VERSION" else SourceError)(f"{args.incident} can't be taken", code)
        sessions = plans.connector(spark, args.agent, args.home).discover(args.session)
        incident = sessions.select("session_id", F.lit(text).alias("value"))
    made = plans.capture(spark, args.agent, args.home, args.session, args.out, incident=incident, repository=args.repo, registry=_registry(args.policy), allow_blocked=args.allow_blocked).collect()
    if not made:
        raise PolicyError("the export is blocked: high-confidence secrets were found")
    _told(made, args.json)
    return EXIT["ok"]


def _preview(args) -> int:
    spark = _spark()
    source = plans.connector(spark, args.agent, args.home)
    done = plans.redact_lines(plans.session_lines(source.read(source.discover(args.session))), registry=_registry(args.policy))
    done = plans.Working(spark, "preview").keep(done)
    totals = report.preview(report.inventory(done, "path", "text", "session_id"), "session_id")
    if args.json:
        _told(totals.collect(), True)
    else:
        for row in report.preview_text(done, "session_id").collect():
            print(row.text)
    return EXIT["policy"] if totals.where("export_blocked").take(1) else EXIT["ok"]


def _inspect(args) -> int:
    summary, files = plans.inspect(_spark(), args.bundle)
    _told(summary.collect(), args.json)
    _told(files.orderBy("bundle_id", "path").collect(), args.json)
    return EXIT["ok"]


def _verify(args) -> int:
    issues, verdict = plans.verify(_spark(), args.bundle, args.strict)
    _told(issues.orderBy("bundle", "severity", "code", "message").collect(), args.json)
    rows = verdict.orderBy("bundle").collect()
    _told(rows, args.json)
    return max((r.exit_code for r in rows), default=EXIT["source"])


def _prepare(args) -> int:
    if not args.yes:
        raise ConfirmationError("prepare makes a working tree; confirm with --yes")
    print(prepare(_spark(), args.bundle, args.repo, args.dir))
    return EXIT["ok"]


def _redact_test(args) -> int:
    if not Path(args.file).is_file():
        raise UsageError(f"no such file: {args.file}", "E_USAGE")
    rows = _spark().createDataFrame([(args.file, Path(args.file).read_text(encoding="utf-8", errors="replace"))], "path string, text string")
    done = redact(rows, "text", registry=_registry(args.policy), salt=None, changes="changes")
    found = report.changes(done).drop("high", "pass").collect()
    _told(found, args.json)
    return EXIT["ok"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logbrook", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *words: str, **flags):
        sub = commands.add_parser(name)
        for word in words:
            sub.add_argument(word)
        for flag, how in flags.items():
            sub.add_argument(f"--{flag.replace('_', '-')}", **how)
        sub.add_argument("--json", action="store_true")
        sub.set_defaults(run=run)

    yes, text = {"action": "store_true"}, {"default": None}
    source = {"agent": {"required": True}, "home": {"default": f"file://{Path.home()}"}, "session": {"default": "last"}, "policy": text}
    command("capture", _capture, "out", **source, incident=text, repo=text, allow_blocked=yes, yes=yes)
    command("preview", _preview, **source)
    command("inspect", _inspect, "bundle")
    command("verify", _verify, "bundle", strict=yes)
    command("prepare", _prepare, "bundle", repo={"required": True}, dir={"required": True}, yes=yes)
    command("redact-test", _redact_test, "file", policy=text)
    try:
        args = parser.parse_args(argv)
    except SystemExit as end:
        return EXIT["usage"] if end.code else EXIT["ok"]
    try:
        return args.run(args)
    except Failure as problem:
        print(f"error {problem}", file=sys.stderr)
        return problem.exit_code


if __name__ == "__main__":
    sys.exit(main())
