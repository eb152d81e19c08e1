"""Command line: ``info PATH``, ``convert SOURCE TARGET [FORMAT]``, ``formats [TEXT]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str]) -> int:
    from lodestone import model
    from lodestone.operators.catalog import search
    from lodestone.operators.exports import export_objects
    from lodestone.sources.files import import_files, read_files

    if not args or args[0] not in ("info", "convert", "formats"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args[0] == "formats":
        search(model.formats(spark), args[1] if len(args) > 1 else "").orderBy("category", "format").show(100, False)
        return 0
    objects = import_files(read_files(spark, args[1]))
    if args[0] == "info":
        objects.select("original_filename", "detected_format", "object_type", "size", "checksum", "support_level", "warnings", F.left("content", F.lit(200)).alias("content")).show(50, False, True)
        return 0
    target = args[3] if len(args) > 3 else args[2].rsplit(".", 1)[-1].lower()
    out = export_objects(objects, target).select("data", "refusal").first()
    if out is None or out["refusal"]:
        print(out["refusal"] if out else f"no file at {args[1]}")
        return 1
    with open(args[2], "wb") as f:
        f.write(out["data"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
