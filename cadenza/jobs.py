"""Batch jobs: ``spark-submit cadenza/jobs.py JOB --option value``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from cadenza.functions.text import derived_id, match_key, truncated
from cadenza.operators import cooccurrence, matching
from cadenza.operators.insights import MEASURES
from cadenza.session import session
from cadenza.sources import catalog_csv, sinks


def seed_catalog(spark, source: str, target: str) -> None:
    """Valid rows of a catalogue file whose id the target lacks; the first row of an id in file order counts."""
    rows = catalog_csv.read_catalog(spark, source).withColumnsRenamed({"track_id": "id", "track_name": "name"})
    measures = [m.lower() for m in MEASURES] + ["key", "mode", "time_signature"]
    valid = rows.where(matching.validity(rows, measures).isNull())
    first = matching.first_of(valid, ["id"], "row_index")
    sinks.append_new(first.withColumn("match_key", match_key(F.col("name"), F.col("artists"))), target, "id")


def seed_references(spark, catalog: str, target: str) -> None:
    """A row for each credited artist, with an id derived from the name."""
    credits = matching.credits_table(spark.read.parquet(catalog), "id", "artists")
    sinks.append_new(credits.select(derived_id(F.col("artist")).alias("id"), F.col("artist").alias("name")), target, "id")


def seed_playlists(spark, source: str, catalog: str, target: str) -> None:
    """Playlists whose tracks resolve to one catalogue track by key, in the order of the files; ambiguous keys are discarded."""
    rows = catalog_csv.read_playlists(spark, source, place="row_id")
    keyed = rows.withColumn("match_key", match_key(F.col("track"), F.col("artist")))
    found = keyed.join(matching.unique_keys(spark.read.parquet(catalog)), "match_key", "left")
    named = found.select("row_id", derived_id(F.col("user_id"), F.col("playlist")).alias("playlist"), F.col("id").alias("track"), truncated(F.col("playlist")).alias("name"))
    names = named.groupBy("playlist").agg(F.min("name").alias("name"))
    lists = matching.accumulate(named.drop("name")).join(names, "playlist")
    sinks.append_new(lists.select(F.col("playlist").alias("id"), "name", "track_ids"), target, "id")


def build_cooccurrence(spark, playlists: str, target: str) -> None:
    members = spark.read.parquet(playlists).select(F.col("id").alias("basket"), F.explode("track_ids").alias("item"))
    sinks.rebuild(cooccurrence.matrix(members), target)


JOBS = {"seed-catalog": seed_catalog, "seed-references": seed_references, "seed-playlists": seed_playlists, "build-cooccurrence": build_cooccurrence}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        options = jobs.add_parser(name)
        for option in job.__code__.co_varnames[1 : job.__code__.co_argcount]:
            options.add_argument(f"--{option}", required=True)
    chosen = vars(parser.parse_args(args))
    JOBS[chosen.pop("job")](session(), **chosen)


if __name__ == "__main__":
    main()
