"""python -m roadcut ALGORITHM GRAPH POINTS OUT MAX_WEIGHT MAX_RADIUS [-p SHARE]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="roadcut")
    p.add_argument("algorithm", choices=["IF", "BUP", "BUS"])
    p.add_argument("graph")
    p.add_argument("points")
    p.add_argument("out")
    p.add_argument("max_weight", type=float)
    p.add_argument("max_radius", type=float)
    p.add_argument("-p", "--share", type=float, default=0.25, help="weight of the source and sink sets")
    a = p.parse_args()
    from roadcut.plans import city

    spark = SparkSession.builder.appName("roadcut").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    city.run(spark, a.algorithm, a.graph, a.points, a.out, a.max_weight, a.max_radius, share=a.share).show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
