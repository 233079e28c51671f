"""``python -m inodeon``: searches an image or a volume, or reports on it; ``spark-submit`` takes the file alike."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from inodeon.model import MatchFlags
from inodeon.operators import match, stats
from inodeon.sources import mft


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="inodeon", description=__doc__)
    parser.add_argument("image", help="image file, folder of image parts, or volume")
    parser.add_argument("text", nargs="?", help="what to look for in names; without it, the first names are shown")
    parser.add_argument("--exact", action="store_true", help="the whole name instead of a part of it")
    parser.add_argument("--paths", action="store_true", help="with full paths")
    parser.add_argument("--drive", default="", help="letter in front of the paths")
    parser.add_argument("--volume", action="store_true", help="the file is a volume, not its record table alone")
    parser.add_argument("--skip-prefix", choices=("true", "false", "auto"), default="auto")
    parser.add_argument("--out", help="write all rows there as Parquet instead of showing some")
    parser.add_argument("--rows", type=int, default=25, help="rows to show")
    parser.add_argument("--report", action="store_true", help="what a scan took in all its tasks, instead of a search")
    return parser.parse_args(argv)


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    options = {"layout": "volume" if args.volume else "image", "skipPrefix": args.skip_prefix}
    if args.report:
        rows, seen = mft.measured_image(spark, args.image, **options)
        rows.write.format("noop").mode("overwrite").save()
        spent = seen.get
        timed = spark.createDataFrame([(args.image, spent["total_records"], spent["io_ms"] + spent["fixup_ms"] + spent["parse_ms"])], "image string, records long, ms double")
        return stats.report(timed, "image", "records", "ms")
    records = mft.read_image(spark, args.image, drive=args.drive, **options)
    if args.text is None:
        return match.first_names(records, args.rows)
    flags = (MatchFlags.EXACT if args.exact else MatchFlags.CONTAINS) | (MatchFlags.RESOLVE_PATHS if args.paths else MatchFlags.NONE)
    found = match.find_by_name(records, args.text, flags, args.drive)
    return found.select("record_number", "file_name", *(["full_path"] if args.paths else []))


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    found = result(SparkSession.builder.appName("inodeon").getOrCreate(), args)
    if args.out:
        found.write.parquet(args.out)
    else:
        found.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
