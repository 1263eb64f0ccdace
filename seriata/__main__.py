"""python -m seriata QUERY TABLES [OUT]: run a registered query over a folder of tables; without OUT show the first rows."""

import sys

from pyspark.sql import SparkSession

from seriata.plans.queries import QUERIES


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(f"{__doc__}\nQueries: {' '.join(sorted(QUERIES))}")
        return 2
    spark = SparkSession.builder.appName(f"seriata {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[args[0]](spark, args[1])
    if len(args) == 3:
        df.write.parquet(args[2])
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
