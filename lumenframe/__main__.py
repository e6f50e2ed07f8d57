"""Command line: scan, search, dupes, clusters, best and stats over a catalog."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .library import SEARCH_LIMIT, Library
from .sources.models import OnnxEmbedder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenframe")
    p.add_argument("--db", required=True, help="folder of the catalog")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("root")
    for command in (scan, look := sub.add_parser("search")):
        command.add_argument("--models", help="folder with vision.onnx, text.onnx and tokenizer.json, and aesthetic.bin if there is one")
    look.add_argument("query")
    look.add_argument("--limit", type=int, default=SEARCH_LIMIT)
    sub.add_parser("dupes")
    sub.add_parser("stats")
    clusters = sub.add_parser("clusters")
    clusters.add_argument("--kind", choices=("near", "burst"))
    clusters.add_argument("--dhash", type=bits)
    clusters.add_argument("--phash", type=bits)
    clusters.add_argument("--gap", type=int)
    clusters.add_argument("--cos", type=float)
    best = sub.add_parser("best")
    best.add_argument("--gap", type=int, default=7200)
    return p


def bits(text: str) -> int:
    """A number of bits, 64 at most."""
    return min(64, max(0, int(text)))


def attach(library: Library, folder: str) -> None:
    """Attach the models of a folder; without an aesthetic head images get no aesthetic score."""
    library.attach_models(OnnxEmbedder(*(os.path.join(folder, n) for n in ("vision.onnx", "text.onnx", "tokenizer.json"))))
    head = os.path.join(folder, "aesthetic.bin")
    if os.path.exists(head):
        with open(head, "rb") as f:
            library.attach_models(library.embedder, f.read())


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    library = Library(SparkSession.builder.appName("lumenframe").getOrCreate(), a.db)
    if getattr(a, "models", None):
        attach(library, a.models)
    if a.command == "search":
        library.search(a.query, a.limit).show(a.limit, False)
    elif a.command == "scan":
        for name, n in library.scan(a.root).items():
            print(f"{name}: {n}")
    elif a.command == "dupes":
        library.dupes().show(100, False)
    elif a.command == "stats":
        library.stats().show(1, False, True)
    elif a.command == "best":
        library.best_of(a.gap).show(100, False)
    else:
        if a.dhash is not None or a.phash is not None:
            library.cluster_near(**{k: v for k, v in (("dhash_bits", a.dhash), ("phash_bits", a.phash)) if v is not None})
        if a.gap is not None or a.cos is not None:
            library.cluster_bursts(**{k: v for k, v in (("gap", a.gap), ("least_cosine", a.cos)) if v is not None})
        library.clusters(a.kind).show(100, False)


if __name__ == "__main__":
    main()
