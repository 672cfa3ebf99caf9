"""Command line and config file of a job: a small TOML file names what the command line may override."""

from __future__ import annotations

import argparse
import logging
import tomllib
from pathlib import Path


def settings(job: str, argv: list[str] | None, **about: str) -> dict:
    """The values of the job's config file, with what the command line says put in their place; about: option -> help."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    p.add_argument("--config", default=str(Path(__file__).with_name(f"{job}.toml")))
    for name, says in about.items():
        p.add_argument(f"--{name.replace('_', '-')}", help=says)
    args = vars(p.parse_args(argv))
    with open(args.pop("config"), "rb") as f:
        held = tomllib.load(f)
    unknown = set(held) - set(about)
    if unknown:
        p.error(f"the config file has unknown names: {', '.join(sorted(unknown))}")
    held |= {k: v for k, v in args.items() if v is not None}
    missing = [k for k in about if k not in held]
    if missing:
        p.error(f"neither the config file nor the command line has {', '.join(missing)}")
    return held


def session(job: str):
    """A session for the command line, and logs on the screen."""
    from pyspark.sql import SparkSession

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
