"""Command line: build an index, and answer queries from one."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from lexmill.operators.index import posting_lists, postings, with_shards, write_index
from lexmill.plans.boolean import BooleanEngine, QuerySyntaxError
from lexmill.sources.binary_index import export_index
from lexmill.sources.corpus import list_corpus, read_corpus


def build(spark: SparkSession, corpus: str, out: str, nltk: bool = False, binary: bool = False, shards: int | None = None) -> None:
    """Indexes a folder; SystemExit(1) if it is missing or has no files."""
    if not os.path.isdir(corpus) or not list_corpus(corpus):
        print(f"no corpus in {corpus}", file=sys.stderr)
        raise SystemExit(1)
    docs = read_corpus(spark, corpus)
    index = postings(docs, nltk, unique=True)
    if binary:
        export_index(posting_lists(index), out)
    elif shards:
        write_index(index.join(with_shards(docs, shards).select("doc_id", "shard"), "doc_id"), out, shards)
    else:
        write_index(index, out)


def answer(engine: BooleanEngine, line: str) -> list[int]:
    return [r.doc_id for r in engine.query(line).orderBy("doc_id").toLocalIterator()]


def interactive(engine: BooleanEngine, lines, out=sys.stdout) -> None:
    """Prints `Results: [...]` for each query until q or quit; empty lines are skipped, errors reported."""
    for line in lines:
        line = line.strip()
        if line in ("q", "quit"):
            return
        if not line:
            continue
        try:
            print(f"Results: [{', '.join(map(str, answer(engine, line)))}]\n", file=out, flush=True)
        except QuerySyntaxError as error:
            print(f"Error: {error}", file=sys.stderr)


def bench(engine: BooleanEngine, lines, out=sys.stdout) -> None:
    """Prints READY, then a line of ids for each query, blank for a wrong one, until EXIT or the end."""
    print("READY", file=out, flush=True)
    for line in lines:
        if line.strip() == "EXIT":
            return
        try:
            print(" ".join(map(str, answer(engine, line))), file=out, flush=True)
        except QuerySyntaxError as error:
            print(file=out, flush=True)
            print(f"Error: {error}", file=sys.stderr)


class Timed:
    """An engine that reports the milliseconds of each query."""

    def __init__(self, engine: BooleanEngine, out=sys.stderr):
        self.engine, self.out = engine, out

    def query(self, line: str):
        began = time.time()
        found = self.engine.query(line).cache()
        print(f"{found.count()} documents in {(time.time() - began) * 1000:.1f} ms: {line}", file=self.out)
        return found


def warmed(engine: BooleanEngine, lines, n: int):
    """The lines, of which the first n queries are answered once before."""
    first = [line for _, line in zip(range(n), lines)]
    for line in first:
        try:
            answer(engine, line)
        except QuerySyntaxError:
            pass
    yield from first
    yield from lines


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexmill")
    kinds = parser.add_subparsers(dest="kind", required=True)
    p = kinds.add_parser("build")
    p.add_argument("--corpus", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--nltk", action="store_true")
    p.add_argument("--binary", action="store_true")
    p.add_argument("--shards", type=int)
    p = kinds.add_parser("query")
    p.add_argument("index", nargs="?")
    p.add_argument("--index", dest="path", help="the same as the argument")
    p.add_argument("--warmup", type=int, default=0, help="lines of standard input that are answered without output first")
    p.add_argument("--verbose", action="store_true", help="reports the milliseconds of each query")
    p.add_argument("--nltk", action="store_true")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--interactive", action="store_true")
    mode.add_argument("--bench", action="store_true")
    mode.add_argument("--bench-init", action="store_true")
    said = parser.parse_args(args)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if said.kind == "build":
        build(spark, said.corpus, said.out, said.nltk, said.binary, said.shards)
        return 0
    began = time.time()
    try:
        if not (said.path or said.index):
            parser.error("an index is needed")
        engine = BooleanEngine.open(spark, said.path or said.index, said.nltk)
    except Exception as error:  # a missing or foreign path
        print(error, file=sys.stderr)
        return 1
    if said.bench_init:
        print(f"INIT_TIME_MS: {(time.time() - began) * 1000:.4f}")
    else:
        lines = warmed(engine, sys.stdin, said.warmup)
        (bench if said.bench else interactive)(Timed(engine) if said.verbose else engine, lines)
    return 0


if __name__ == "__main__":
    sys.exit(main())
