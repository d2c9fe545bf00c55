"""Command line: python -m quillsift.cli."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import SparkSession

from . import __version__, config
from .functions import registry
from .operators import selection
from .plans import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillsift", description="Find and redact card numbers and e-mail addresses in files.")
    p.add_argument("-c", "--create-conf", metavar="FILE", help="write the default configuration and stop")
    p.add_argument("-d", "--default-conf", action="store_true", help="use the default configuration")
    p.add_argument("-f", "--conf-file", metavar="FILE", default="quillsift.toml")
    p.add_argument("-p", "--max-process", type=int, metavar="N", help="cores to use at most")
    p.add_argument("--start-dir", action="append", help="scan this directory instead of the configured ones")
    p.add_argument("--cpu-count", action="store_true", help="show the number of cores and stop")
    p.add_argument("--list-datahandlers", action="store_true")
    p.add_argument("--list-filetypes", action="store_true")
    p.add_argument("--mime", nargs="+", metavar="FILE", help="show the media type of files and stop")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.create_conf:
        said = config.write_default(args.create_conf)
        print(said)
        return int(said != "Success")
    if args.cpu_count:
        print(os.cpu_count())
        return 0
    if args.list_datahandlers:
        print("\n".join(registry.supported()))
        return 0
    if args.list_filetypes:
        print("\n".join([*selection.supported("ext"), *selection.supported("mime")]))
        return 0
    if args.mime:
        for name in args.mime:
            if os.path.isdir(name):
                print(f"{name}: Directory")
            else:
                with open(name, "rb") as f:
                    print(f"{name}: {selection.media_type_of(f)}")
        return 0
    chosen = config.load(None if args.default_conf else args.conf_file)
    for name in chosen.ignored:
        print(f"ignored: {name}")
    if args.start_dir:
        chosen = replace(chosen, start_dirs=args.start_dir)
    cores = min(os.cpu_count() or 1, args.max_process or os.cpu_count() or 1)
    spark = SparkSession.builder.appName("quillsift").master(os.environ.get("SPARK_MASTER", f"local[{cores}]")).getOrCreate()
    scan.run(spark, chosen)
    print("\n".join(chosen.results.values()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
