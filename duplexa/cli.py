"""Command line: `python -m duplexa.cli db` builds a database from FASTA, `ris` searches one."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.energy import Model, load_loops
from .plans.search import SearchParameters, search_store, write_text
from .sources.fasta import read_fasta
from .sources.store import SCHEDULES, BuildParameters, Store, build


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="duplexa", description=__doc__)
    modes = out.add_subparsers(dest="mode", required=True)
    db = modes.add_parser("db", help="build a database")
    db.add_argument("-i", dest="source", required=True, help="FASTA of targets")
    db.add_argument("-o", dest="database", required=True)
    db.add_argument("-r", dest="repeat", type=int, default=0, choices=(0, 1, 2), help="0 hard mask, 1 soft mask, 2 none")
    db.add_argument("-s", dest="index", type=int, default=8, help="window size of the stored index")
    db.add_argument("-w", dest="span", type=int, default=70, help="most bases that a pair encloses")
    db.add_argument("-d", dest="least", type=int, default=5, help="accessible length")
    db.add_argument("-c", dest="page", type=int, default=None, help="sequences to a page")
    db.add_argument("-a", dest="schedule", default="heap", choices=SCHEDULES)
    ris = modes.add_parser("ris", help="search")
    ris.add_argument("-i", dest="source", required=True, help="FASTA of queries")
    ris.add_argument("-o", dest="output", required=True)
    ris.add_argument("-d", dest="database", required=True)
    for flag, name, kind, default in (("-l", "most", int, 20), ("-e", "seed", float, -6.0), ("-f", "interaction", float, -4.0), ("-g", "final", float, -8.0), ("-x", "drop_gapped", int, 16), ("-y", "drop_ungapped", int, 5), ("-m", "helix", int, 3), ("-s", "style", int, 0)):
        ris.add_argument(flag, dest=name, type=kind, default=default)
    ris.add_argument("-a", dest="schedule", default="area", choices=("block", "area", "dynamic"))
    for p in (db, ris):
        p.add_argument("--loops", default=None, help="CSV or Parquet table of 1x1, 1x2 and 2x2 interior loops; without it a rule stands in")
        p.add_argument("-p", dest="scratch", default=None, help="accepted for compatibility; Spark's local folders are its configuration")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("duplexa").getOrCreate()
    sequences = read_fasta(spark, a.source)
    model = Model(load_loops(spark, a.loops)) if a.loops else None
    if a.mode == "db":
        build(sequences, a.database, BuildParameters(a.repeat, a.index, a.span, a.least, a.page, a.schedule), model)
        return
    parameters = SearchParameters(a.most, a.seed, a.interaction, a.final, a.drop_gapped, a.drop_ungapped, a.helix, a.style)
    store = Store.open(spark, a.database)
    write_text(search_store(sequences.withColumnRenamed("ord", "seq_id"), store, parameters, model), a.output, store, parameters, a.source, a.database)


if __name__ == "__main__":
    main()
