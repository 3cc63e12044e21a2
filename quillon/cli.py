"""Schema and DDL from a CSV file: python -m quillon.cli data.csv --platform spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import casts, validation
from .schema.canonical import infer
from .schema.ddl import DIALECTS, create_table, load_text, schema_json
from .sources.files import read_csv, write_csv


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("input")
    p.add_argument("--platform", nargs="+", default=["spark"], choices=list(DIALECTS))
    p.add_argument("--table", default="data")
    p.add_argument("--output", choices=["ddl", "schema", "dictionary", "load", "json"], default="ddl")
    p.add_argument("--partition-by", nargs="*", default=[])
    p.add_argument("--cluster-by", nargs="*", default=[])
    p.add_argument("--validate", action="store_true")
    p.add_argument("--prepare", metavar="FOLDER", help="write the prepared rows there")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    df = read_csv(spark, a.input)
    if a.validate:
        found = validation.validate(df)
        for kind, lines in found.items():
            for line in lines:
                print(f"{kind}: {line}", file=sys.stderr)
        if found["errors"]:
            return 1
    if a.prepare:
        write_csv(casts.prepare(df), a.prepare)
    schema = infer(df, a.table, partition_columns=a.partition_by, cluster_columns=a.cluster_by)
    if errors := schema.validate():
        print("\n".join(errors), file=sys.stderr)
        return 1
    for platform in a.platform:
        print({"ddl": lambda x: create_table(schema, x), "schema": lambda x: schema.to_json(), "dictionary": lambda x: schema.data_dictionary(platform=x), "load": lambda x: load_text(schema, x, a.input), "json": lambda x: schema_json(schema)}[a.output](platform))
    return 0


if __name__ == "__main__":
    sys.exit(main())
