"""python -m factloom [NAME SF_DIR]: list the queries, or run one and show its first rows."""

import sys


def main(args: list[str]) -> int:
    from factloom.plans import registry

    if len(args) != 2:
        print("\n".join(sorted(registry.queries())))
        return 0 if not args else 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry.queries()[args[0]](spark, args[1]).show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
