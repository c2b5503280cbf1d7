"""``python -m gleaner.cli``: index a folder, search it, show its status, export training rows."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from gleaner.functions.text import context_lines
from gleaner.plans.search import Index, SearchOptions
from gleaner.session import session
from gleaner.sources.entries import directory


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    p.add_argument("--master", help="Spark master, if it isn't set elsewhere")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index", help="add the files of a folder that changed, forget those that are gone")
    one.add_argument("folder")
    one.add_argument("--index", default=".index")
    one.add_argument("--no-gitignore", action="store_true")
    two = sub.add_parser("search", help="search for words, a \"phrase\" or a /pattern/")
    two.add_argument("query")
    two.add_argument("--index", default=".index")
    two.add_argument("--top", type=int, default=10)
    two.add_argument("--format", choices=("text", "json"), default="text")
    two.add_argument("--context", type=int, default=0)
    for flag in ("--fresh-only", "--no-expand", "--no-window-scoring", "--no-df-filter", "--debug"):
        two.add_argument(flag, action="store_true")
    three = sub.add_parser("status", help="counters of the index")
    three.add_argument("--index", default=".index")
    four = sub.add_parser("export-training", help="windows of the given queries as JSON lines")
    four.add_argument("out")
    four.add_argument("queries", nargs="+")
    four.add_argument("--index", default=".index")
    return p


def main(argv: list[str] | None = None, out=sys.stdout) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    spark = session(args.master)
    index = Index.open_or_create(spark, args.index)
    if args.command == "index":
        n = index.index_files(directory(spark, args.folder, gitignore=not args.no_gitignore))
        index.build_pending_shards()
        print(f"{n} files added", file=out)
    elif args.command == "status":
        print(json.dumps(index.status().first().asDict()), file=out)
    elif args.command == "export-training":
        print(f"{index.export_training(args.queries, args.out)} queries exported", file=out)
    else:
        options = SearchOptions(top_k=args.top, fresh_only=args.fresh_only, no_expand=args.no_expand, no_window_scoring=args.no_window_scoring, no_df_filter=args.no_df_filter)
        outcome = index.search_with_outcome(args.query, options)
        found = outcome.results
        if args.context:
            texts = index.entries().select("wal_entry_id", "content")
            around = context_lines(F.col("content"), F.col("line_start"), F.col("line_end"), args.context)
            found = found.join(texts, "wal_entry_id").withColumn("snippet", around).drop("content")
        # the answer is at most as long as --top
        rows = found.orderBy(F.desc("score"), "source_path", "line_start").collect()
        if args.format == "json":
            print(json.dumps([{"path": r["source_path"], "line": r["line_start"], "chunk_id": r["chunk_id"], "byte_range": [r["byte_start"], r["byte_end"]], "snippet": r["snippet"], "score": r["score"], "layer": r["layer"]} for r in rows]), file=out)
        else:
            for r in rows:
                print(f"[{r['layer']}] {r['source_path']}:{r['line_start']}:{r['byte_start']}-{r['byte_end']}:" + (r["snippet"] or "").replace("\n", "\\n"), file=out)
        if args.debug:
            print(f"plan {outcome.plan}, layers {', '.join(outcome.layers)}, {outcome.seconds:.2f} s to plan", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
