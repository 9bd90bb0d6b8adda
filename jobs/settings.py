"""What the jobs' command lines share: settings, logs and a session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession


def read(file: str, argv: list[str], paths: dict[str, str]) -> dict:
    """Settings from the config file beside ``file`` (or ``--config``), then from the command
    line: each of ``paths`` and each setting of the config is an option of its own."""
    config = os.path.splitext(os.path.abspath(file))[0] + ".json"
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=config)
    with open(first.parse_known_args(argv)[0].config) as f:
        settings = json.load(f)
    parser = argparse.ArgumentParser(parents=[first], formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", default=settings.get(name), required=name not in settings, help=text)
    for name, value in settings.items():
        if name not in paths:
            parser.add_argument(f"--{name}", default=value, type=json.loads if isinstance(value, (list, dict)) else type(value))
    return {k: v for k, v in vars(parser.parse_args(argv)).items() if k != "config"}


def main(file: str, name: str, paths: dict[str, str], run: Callable) -> None:
    """The command line: makes a session, runs the job, stops the session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    settings = read(file, sys.argv[1:], paths)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
