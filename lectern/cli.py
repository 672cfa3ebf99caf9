"""Command line: ``run`` (the default), ``watch``, ``stream``, ``lint`` and ``clear``."""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys

from lectern.operators.model import DEFAULT_MODEL, from_environment


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description="Turns a tree of documents into indexed Markdown.")
    p.add_argument("--input", help="folder with the documents")
    p.add_argument("--output", default="./output")
    p.add_argument("--temp", default="./temp")
    p.add_argument("--model", default=DEFAULT_MODEL)
    p.add_argument("--compat", action="store_true", help="follow the historic filter rules to the letter")
    sub = p.add_subparsers(dest="command")
    clear = sub.add_parser("clear", help="remove work files, with --all outputs too")
    clear.add_argument("--output", default="./output")
    clear.add_argument("--temp", default="./temp")
    clear.add_argument("--all", action="store_true")
    clear.add_argument("--yes", action="store_true", help="don't ask")
    stream = sub.add_parser("stream", help="filter, lint and index extracted texts (Parquet: rel_path, mtime, markdown) that arrived below a folder, each once")
    stream.add_argument("arrivals")
    stream.add_argument("--output", default="./output")
    stream.add_argument("--temp", default="./temp")
    stream.add_argument("--compat", action="store_true")
    look = sub.add_parser("watch", help="run over the files of a tree that are new or changed since the last watch")
    look.add_argument("tree")
    look.add_argument("--output", default="./output")
    look.add_argument("--temp", default="./temp")
    look.add_argument("--model", default=DEFAULT_MODEL)
    look.add_argument("--compat", action="store_true")
    look.add_argument("--every", help='keep looking, so often (such as "1 minute"); without it, once')
    tidy = sub.add_parser("lint", help="lint the Markdown files below a folder in place")
    tidy.add_argument("directory")
    return p


def _log(folder: str) -> logging.Logger:
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger("lectern")
    log.setLevel(logging.DEBUG)
    log.handlers.clear()
    screen, file = logging.StreamHandler(), logging.FileHandler(os.path.join(folder, "extraction.log"), encoding="utf-8")
    screen.setLevel(logging.INFO)
    for h in (screen, file):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%H:%M:%S"))
        log.addHandler(h)
    return log


def _clear(args) -> int:
    targets = [t for t in ([args.temp, args.output] if args.all else [args.temp]) if os.path.exists(t)]
    if not targets:
        print("Nothing to remove.")
        return 0
    if not args.yes and input(f"Remove {', '.join(targets)}? [y/N] ").strip().lower() != "y":
        print("Nothing removed.")
        return 0
    left = []
    for t in targets:
        shutil.rmtree(t, onexc=lambda _, path, e: left.append(f"{path}: {e}"))
    for x in left:
        print(f"Not removed: {x}")
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "clear":
        return _clear(args)
    if args.command == "lint" and not os.path.isdir(args.directory):
        print(f"No such folder: {args.directory}", file=sys.stderr)
        return 1
    if args.command == "stream" and not os.path.isdir(args.arrivals):
        print(f"No such folder: {args.arrivals}", file=sys.stderr)
        return 1
    if args.command == "watch" and not os.path.isdir(args.tree):
        print(f"No such folder: {args.tree}", file=sys.stderr)
        return 1
    if args.command is None and not args.input:
        p.error("--input is required")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from pyspark.sql import functions as F

    from lectern.plans.run import Options, lint_tree, read_progress, run, write_index

    if args.command == "stream":
        from lectern.streaming.incremental import outputs, process_new, tidy

        state = os.path.join(args.temp, "stream_progress")
        process_new(spark, args.arrivals, state, os.path.join(args.temp, "stream_checkpoint"), tidy(args.compat), write=outputs(args.output))
        print(f"{read_progress(spark, state).count()} documents done, {write_index(spark, args.output, os.path.join(args.temp, 'stream_entries'))} indexed")
        return 0
    if args.command == "lint":
        rows = lint_tree(spark, args.directory)
        for r in rows.orderBy(F.split("path", "/")).toLocalIterator():
            print(f"{r.path}: {r.fixed_count} fixed, {len(r.remaining_failures)} remaining{' [fast]' if r.fast_mode else ''}")
        t = rows.agg(F.count("*"), F.coalesce(F.sum("fixed_count"), F.lit(0)), F.coalesce(F.sum(F.size("remaining_failures")), F.lit(0)), F.coalesce(F.sum((F.col("fixed_count") > 0).cast("int")), F.lit(0))).head()
        print(f"{t[0]} files: {t[1]} fixes in {t[3]} files, {t[2]} issues remain")
        return 0
    log = _log(args.output)
    if args.command == "watch":
        from lectern.streaming.files import watch

        options, codes = Options(args.tree, args.output, args.temp, from_environment(args.model), args.compat), [0]
        query = watch(spark, args.tree, os.path.join(args.temp, "watch_checkpoint"), lambda files: codes.append(_tell(log, run(spark, options, files))), args.every)
        query.awaitTermination()
        return max(codes)
    return _tell(log, run(spark, Options(args.input, args.output, args.temp, from_environment(args.model), args.compat)))


def _tell(log: logging.Logger, report) -> int:
    log.info("discovered %d, pending %d, processed %d, skipped %d, failed %d", report.discovered, report.pending, report.processed, report.skipped, report.failed)
    log.info("formats: %s", ", ".join(f"{n} {x}" for x, n in report.formats.items()) or "none")
    if report.ocr:
        log.info("ocr: %d extracted, %d blank, %d failed, %d characters", *(report.ocr[x] or 0 for x in ("extracted", "blank", "failed", "chars")))
    log.info("tokens: %d prompt, %d completion", *report.tokens)
    log.info("lint: %d fixed, %d remaining; model: %d calls, cost %.4f", report.lint_fixed, report.lint_remaining, report.calls, report.cost)
    if report.aborted:
        log.error("%s", report.aborted)
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
