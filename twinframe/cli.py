"""Commands: analyze, explain, doctor, init, profile, cache. Exit codes: 0; 1 if an edit is recommended; 2 for wrong settings; 3 for a fault here; 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from . import __version__, config


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("twinframe").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()


def analyze(args) -> int:
    from .plans.analyze import analyze_folder
    from .sources import reports

    c = config.load(args.path, {"output": args.output, "split_test": args.split_test})
    found = analyze_folder(session(), c.root, c.include, c.exclude, policy=c.policy)
    metrics = reports.write(found, c.output, args.target_limit, args.debug, {"digest": c.digest})
    if args.format == "json":
        print(json.dumps(metrics, sort_keys=True))
    elif args.format == "ci":
        few = reports.lean(found.findings).filter("size(members) <= 12").orderBy("rank").limit(10).toJSON().collect()
        print(json.dumps(reports.ci_payload(metrics, c.output, [json.loads(x) for x in few]), sort_keys=True))
    elif args.format == "ndjson":
        for row in reports.lean(found.findings).orderBy("rank").limit(args.target_limit).toJSON().collect():
            print(row)
    else:
        print((Path(c.output) / "summary.md").read_text())
    return int(metrics["tiers"]["recommended_edit"] > 0)


def explain(args) -> int:
    from .sources import reports

    rows = reports.read_back(session(), args.output, args.id).toJSON().collect()
    print("\n".join(rows) or f"no finding {args.id}")
    return 0 if rows else 2


def doctor(args) -> int:
    c = config.load(args.path)
    from .sources.python_code import extract as parse

    rows, _, fault = parse("probe.py", b"def f(a):\n    return a\n", "source")
    checks = {"runtime": sys.version.split()[0], "version": __version__, "config": c.digest, "parser": "ok" if rows and not fault else fault, "node": shutil.which("node") or "absent", "root": str(config.repository_root(args.path))}
    print(json.dumps(checks, indent=1))
    return 0


def init(args) -> int:
    path = Path(args.path) / "twinframe.toml"
    if path.exists() and not args.force:
        print(f"{path} exists")
        return 2
    path.write_text('include = ["**"]\nexclude = []\nsplit_test = true\n')
    return 0


def profile(args) -> int:
    from pyspark.sql import functions as F

    from .plans.analyze import analyze_folder

    c = config.load(args.path)
    rel = analyze_folder(session(), c.root, c.include, c.exclude, policy=c.policy).relations
    rel.groupBy("cluster").agg(F.count("*").alias("pairs"), F.max("relatedness").alias("strongest"), F.sum("tree.nodes").alias("nodes")).orderBy(F.desc("pairs"), "cluster").limit(5).show(5, False)
    return 0


def cache(args) -> int:
    folder = Path(config.load(args.path).cache)
    if args.what == "clear":
        shutil.rmtree(folder, ignore_errors=True)
    elif folder.exists():
        for p in sorted(folder.iterdir()):
            print(p.name, session().read.parquet(str(p)).count())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("twinframe", description=__doc__)
    sub = parser.add_subparsers(required=True)
    for name, run in (("analyze", analyze), ("doctor", doctor), ("init", init), ("profile", profile)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("path", nargs="?", default=".")
        if name == "analyze":
            p.add_argument("--output")
            p.add_argument("--format", choices=("text", "json", "ndjson", "ci"), default="text")
            p.add_argument("--target-limit", type=int, default=50)
            p.add_argument("--debug", action="store_true")
            p.add_argument("--no-split-test", dest="split_test", action="store_false", default=None)
        if name == "init":
            p.add_argument("--force", action="store_true")
    p = sub.add_parser("explain")
    p.set_defaults(run=explain)
    p.add_argument("id")
    p.add_argument("--output", default="twinframe-report")
    p = sub.add_parser("cache")
    p.set_defaults(run=cache)
    p.add_argument("what", nargs="?", choices=("stats", "clear"), default="stats")
    p.add_argument("--path", default=".")
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except ValueError as e:
        print(f"twinframe: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"twinframe: {type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
