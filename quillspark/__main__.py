"""Command line: ``prepare``, ``render``, ``review`` and ``inbox``.

    python -m quillspark prepare <folder or file> 
    python -m quillspark render <slug>
    python -m quillspark review samples|commit <slug> [<edited review list>]
    python -m quillspark inbox [--watch SECONDS]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Settings, load_settings, rooted
from quillspark.operators.synth import SilentSynthesizer, Synthesizer
from quillspark.plans import inbox, review
from quillspark.plans.prepare import prepare_folder
from quillspark.plans.render import render, speech_service
from quillspark.session import session, ship
from quillspark.sources.store import Store
from quillspark.sources.tables import read_review_json


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--config", default="config.toml")
    parser.add_argument("--work", help="table root; default from the settings")
    parser.add_argument("--silent", action="store_true", help="render silence, without a service")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("prepare").add_argument("path")
    commands.add_parser("render").add_argument("slug")
    reviewing = commands.add_parser("review")
    reviewing.add_argument("step", choices=("samples", "commit"))
    reviewing.add_argument("slug")
    reviewing.add_argument("edited", nargs="?", help="the edited review list; default review.json of the book")
    commands.add_parser("inbox").add_argument("--watch", type=int, default=None)
    return parser


def _backend(settings: Settings, silent: bool) -> Synthesizer:
    return SilentSynthesizer() if silent else speech_service(settings)


def _books(spark: SparkSession, store: Store, slug: str) -> DataFrame:
    return store.read(spark, "books").filter(F.col("slug") == slug).select("slug", "book_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    settings = load_settings(args.config)
    spark = ship(spark or session())
    store = Store(args.work or rooted(settings.paths_work))
    if args.command == "prepare":
        prepare_folder(spark, args.path, store, settings).show(truncate=False)
    elif args.command == "render":
        books = _books(spark, store, args.slug)
        render(spark, store, _backend(settings, args.silent), books, settings=settings).show(truncate=False)
    elif args.command == "review":
        edited = read_review_json(spark, args.edited or f"{store.root}/{args.slug}/review.json")
        edited = edited.withColumn("slug", F.lit(args.slug)).join(
            _books(spark, store, args.slug), "slug"
        )
        if args.step == "samples":
            backend = _backend(settings, args.silent)
            review.samples(spark, store, edited, backend).drop("wav").show(truncate=False)
        else:
            review.commit(spark, store, edited, settings, filed=True).show(truncate=False)
    else:
        folder = rooted(settings.paths_inbox)
        backend = _backend(settings, args.silent)
        inbox.watch(spark, folder, store, backend, settings, args.watch).awaitTermination()


if __name__ == "__main__":
    main()
