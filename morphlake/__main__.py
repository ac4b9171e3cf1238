"""``python -m morphlake JOB ...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import jobs


def main() -> int:
    parser = argparse.ArgumentParser(prog="morphlake")
    sub = parser.add_subparsers(dest="job", required=True)
    for name, arguments in (("generate", ["out"]), ("split", ["root"]), ("validate", ["root"]), ("evaluate", ["root", "completions", "out", "run_id"]), ("rescore", ["out"]), ("examples", ["authored", "out"]), ("token_budget", ["root", "tokenizer"])):
        job = sub.add_parser(name)
        for a in arguments:
            job.add_argument(a)
        if name == "generate":
            job.add_argument("--n", type=int, default=jobs.dataset.CANDIDATES)
            job.add_argument("--seed", type=int, default=jobs.dataset.SEED)
        elif name == "rescore":
            job.add_argument("--root")
            job.add_argument("--measured")
        elif name == "token_budget":
            for a in ("--most-prompt", "--most-completion"):
                job.add_argument(a, type=int, required=True)
            job.add_argument("--prompt-form", default="{}")
            job.add_argument("--end", default="")
    job = sub.add_parser("verify")
    job.add_argument("runs", nargs="+", metavar="FOLDER=ROWS")
    job = sub.add_parser("summarize")
    job.add_argument("out")
    job.add_argument("runs", nargs="+", metavar="NAME=FOLDER")
    given = vars(parser.parse_args())
    name = given.pop("job")
    spark = SparkSession.builder.appName(f"morphlake {name}").getOrCreate()
    if name == "summarize":
        given["runs"] = dict(r.split("=", 1) for r in given["runs"])
    elif name == "verify":
        given["runs"] = {folder: int(rows) for folder, rows in (r.rsplit("=", 1) for r in given["runs"])}
    made = getattr(jobs, name)(spark, **given)
    if name == "validate":
        print(json.dumps(made, indent=2))
        return int(any(made.values()))
    if name in ("token_budget", "verify"):
        print(json.dumps(made, sort_keys=True))
        return int(made.get("status") == "FAIL")
    if isinstance(made, str):
        print(made)
    return 0


if __name__ == "__main__":
    sys.exit(main())
