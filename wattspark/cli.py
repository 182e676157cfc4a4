"""Command line: convert, describe, compat, merge, fetch (CL-*). Exit 1: integrity problems; 2: bad arguments."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("wattspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _verified(store) -> int:
    problems = store.verify(deep=True).collect()
    for p in problems:
        print(f"{p['channel_id']}: {p['problem']}", file=sys.stderr)
    return int(bool(problems))


def convert(a) -> int:
    from .sources.registry import READERS

    if a.dataset not in READERS:
        print(f"unknown dataset {a.dataset}; there are {sorted(READERS)}", file=sys.stderr)
        return 2
    recordings = READERS[a.dataset](session(), a.source, **json.loads(a.options))
    if a.limit is not None:
        recordings = recordings.limited(a.limit)
    store = recordings.write(a.store, overwrite=a.overwrite)
    return _verified(store) if a.verify else 0


def describe(a) -> int:
    from .plans.store import Store

    store = Store(session(), a.store)
    store.describe().orderBy("appliance").show(1000, False)
    return _verified(store) if a.verify else 0


def compat(a) -> int:
    from .plans import compat as C
    from .plans.store import Store

    print(C.compatibility(*(Store(session(), s) for s in a.stores), deep=not a.shallow).summary())
    return 0


def merge(a) -> int:
    from .plans import compat as C
    from .plans.store import Store

    try:
        rename = dict(x.split("=", 1) for x in a.rename)
    except ValueError:
        print("--rename takes FROM=TO", file=sys.stderr)
        return 2
    C.merge_stores([Store(session(), s) for s in a.stores], a.into, a.require, None, rename, a.normalize_voltage, not a.no_prefix, a.overwrite)
    return 0


def fetch(a) -> int:
    from .sources.fetch import Artifact, Plan, fetch as run

    plan = Plan([Artifact(**x) for x in json.loads(open(a.plan).read())])
    print(plan.summary())
    return int(bool(run(plan, a.cache, a.dry_run, max_bytes=a.max_bytes).failed))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wattspark")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("convert")
    c.set_defaults(run=convert)
    for x in ("dataset", "source", "store"):
        c.add_argument(x)
    c.add_argument("--options", default="{}", help="reader arguments as JSON")
    c.add_argument("--limit", type=int)
    c.add_argument("--verify", action="store_true")
    c.add_argument("--overwrite", action="store_true")
    d = sub.add_parser("describe")
    d.set_defaults(run=describe)
    d.add_argument("store")
    d.add_argument("--verify", action="store_true")
    k = sub.add_parser("compat")
    k.set_defaults(run=compat)
    k.add_argument("stores", nargs="+")
    k.add_argument("--shallow", action="store_true")
    m = sub.add_parser("merge")
    m.set_defaults(run=merge)
    m.add_argument("into")
    m.add_argument("stores", nargs="+")
    m.add_argument("--require", action="append")
    m.add_argument("--rename", action="append", default=[])
    m.add_argument("--normalize-voltage", type=float)
    m.add_argument("--no-prefix", action="store_true")
    m.add_argument("--overwrite", action="store_true")
    f = sub.add_parser("fetch")
    f.set_defaults(run=fetch)
    f.add_argument("plan")
    f.add_argument("cache")
    f.add_argument("--dry-run", action="store_true")
    f.add_argument("--max-bytes", type=int)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
