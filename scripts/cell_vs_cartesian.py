"""Time the literal Cartesian plan against the cell join (Location x Place within 200 m), same pairs.

Cartesian side exists here only, as a yardstick.
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from gridwatch.functions.geo import haversine_m  # noqa: E402
from gridwatch.operators import graph, proximity  # noqa: E402
from gridwatch.plans import catalog  # noqa: E402
from gridwatch.plans import params as P  # noqa: E402
from gridwatch.session import build_session, materialised, remove_intermediates  # noqa: E402


def timed(df):
    start = time.perf_counter()
    n = df.count()
    return n, time.perf_counter() - start


def main():
    spark = build_session("local[8]", 16, extra={"spark.driver.memory": "8g"})
    for sf in sys.argv[1:] or [f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1")]:
        # One point per incident, so that both sides grow with the data.
        g = materialised(catalog.g_input(spark, sf).withColumn("location_key", F.col("id")), "bench")
        places = materialised(catalog.places_df(spark, sf), "bench")
        n, cell = timed(proximity.location_place_pairs(g, places, P.NEAR_PLACE_M))
        a, b = graph.location_nodes(g).alias("a"), places.alias("b")
        d = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
        m, cartesian = timed(a.crossJoin(b).filter(d < P.NEAR_PLACE_M))
        assert n == m, (n, m)
        print(f"| {os.path.basename(sf)} | {a.count():,} x {places.count():,} | {n:,} | {cartesian:.1f} | {cell:.1f} |", flush=True)
    remove_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
