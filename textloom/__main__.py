"""Command line: setup (reset), extract, run, chat, clean, records, tree."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators.extract import extract
from textloom.operators.retrieval import TfIdfIndex, context
from textloom.setup import setup
from textloom.sources import corpus, tree
from textloom.sources.model_server import ModelServer

DEFAULT_QUESTION = "what makes a shuffle slow"


@dataclass
class Config:
    root: str = "."
    corpus: str = "data/corpus.jsonl"
    top_k: int = 3


def question(words: Sequence[str], default: str) -> str:
    return " ".join(words) or default


def answer(spark: SparkSession, path: str, text: str, server: ModelServer, k: int = 3, include_query: bool = False) -> str:
    """Retrieve the k best texts of a corpus and have the model answer from them."""
    index = TfIdfIndex.build(corpus.load(spark, path))
    hits = index.retrieve(text, k)
    found = context(hits).first()["context"]  # k texts
    index.unpersist()
    asked = f"\n\nQuestion: {text}" if include_query else ""
    return server.generate_text(f"Context:\n{found}{asked}\n\nAnswer clearly:")


def main(argv: Sequence[str] | None = None, server: ModelServer | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("command")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--corpus", default=Config.corpus)
    parser.add_argument("--depth", type=int)
    parser.add_argument("--width", type=int, default=120)
    parser.add_argument("--out", default="corpus.jsonl")
    parser.add_argument("--no-text", action="store_true")
    parser.add_argument("--prune", action="store_true", help="drop the entries of files that are gone")
    parser.add_argument("-k", type=int, default=Config.top_k)
    parser.add_argument("--host", help="address of the model server")
    parser.add_argument("--model", help="model to ask")
    parser.add_argument("--num-predict", type=int, help="tokens that an answer has at most")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    given = {"host": args.host, "model": args.model, "num_predict": args.num_predict}
    server = server or ModelServer(**{k: v for k, v in given.items() if v is not None})
    command = args.command.lower()
    try:
        if command == "chat":
            print(server.chat(os.environ.get("MSG") or question(args.words, "Hello")))
            return 0
        if command == "clean":
            print("clean does nothing any more")
            return 0
        spark = SparkSession.builder.appName("textloom").getOrCreate()
        if command in ("setup", "reset"):
            print(setup(spark, args.words[0] if args.words else Config.root, server))
        elif command == "extract":
            print(extract(spark, args.words[0] if args.words else Config.root, args.corpus, prune_deleted=args.prune))
        elif command == "run":
            print(answer(spark, args.corpus, question(args.words, DEFAULT_QUESTION), server, args.k))
        elif command in ("records", "tree"):
            root = os.path.abspath(args.words[0] if args.words else ".")
            if not os.path.isdir(root):
                print("not a directory", file=sys.stderr)
                return 2
            if command == "records":
                print(corpus.write_jsonl(tree.directory_records(spark, root, args.depth or 8, not args.no_text), args.out))
            else:
                paths = tree.listing(spark, root, args.depth or 4).where(~F.col("is_dir"))
                for row in tree.directory_lines(paths, args.width).orderBy("sort_key").toLocalIterator():
                    print("\n".join([row["dir"], *row["lines"]]))
        else:
            print(f"unknown command {args.command}", file=sys.stderr)
            return 1
        return 0
    except Exception as e:  # a command line reports any failure and ends with 1
        print(f"{command} failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
