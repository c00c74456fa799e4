"""python -m tessella.plans.prefetch CATALOG.json [--dry-run]: load a catalog's local models ahead of time."""

from __future__ import annotations

import argparse
import json
import sys

from .runtime import Runtime


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("catalog")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    with open(a.catalog) as f:
        raw = json.load(f)
    local = [{**s, "warmup": "lazy"} for s in raw if not s["provider_id"].startswith("remote/")]
    for s in raw:
        if s["provider_id"].startswith("remote/"):
            print(f"skip {s['alias']}: {s['provider_id']} is remote")
    runtime = Runtime.build(local)
    failed = 0
    for alias in runtime.aliases():
        error = None if a.dry_run else runtime.prefetch_report(alias)[0][1]
        print(f"{'would load' if a.dry_run else 'failed' if error else 'loaded'} {alias}{': ' + error if error else ''}")
        failed += bool(error)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
