"""Command line: python -m loomline.sources.ingest us-code|courtlistener|uk --out FOLDER ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import files, remote


#: The command's interface, its flags with their defaults and choices. --landed, our own, names the folder of a run to take up.
OPTIONS: dict[str, dict[str, dict]] = {
    "us-code": {"titles": {"nargs": "*", "default": ["18"]}, "year": {"type": int, "default": 2023}, "api-key": {}, "max-sections": {"type": int}, "xml": {}},
    "courtlistener": {
        "query": {"default": remote.DEFAULT_QUERY}, "court": {}, "max-docs": {"type": int, "default": 50}, "api-token": {},
        "order-by": {"choices": ["score desc", "dateFiled desc"], "default": "score desc"}, "snippets-only": {"action": "store_true"}, "max-chars": {"type": int, "default": 8000},
    },
    "uk": {"statutes": {"nargs": "*"}, "max-sections-per-act": {"type": int}},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomline.sources.ingest", description=__doc__)
    sub = p.add_subparsers(dest="source", required=True)
    for source, options in OPTIONS.items():
        own = sub.add_parser(source)
        for flag, how in (options | {"out": {"required": True}, "landed": {}}).items():
            own.add_argument(f"--{flag}", **how)
    return p


def statute(text: str) -> tuple[str, int, int]:
    kind, year, number = text.split("/")
    return kind, int(year), int(number)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, transport: remote.Transport = remote.http) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.source == "us-code":
        found = remote.code(spark, tuple(a.titles), a.year, a.api_key, a.max_sections, a.xml, transport, a.landed)
    elif a.source == "courtlistener":
        found = remote.judgments(spark, a.query, a.court, a.max_docs, a.api_token, order_by=a.order_by, full_bodies=not a.snippets_only, max_chars=a.max_chars, transport=transport, folder=a.landed)
    else:
        found = remote.acts(spark, tuple(map(statute, a.statutes)) if a.statutes else remote.DEFAULT_ACTS, a.max_sections_per_act, transport, a.landed)
    print(f"{files.write_jsonl(found, a.out)} records -> {a.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
