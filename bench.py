"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "checkins_venues", "venue_visits", "bar_category_summary", "box_stats", "point_in_polygon", "rect_neighbours",
    "geo_features", "dist_features", "closest_city", "radius_join", "geodesic_distance", "text_features_mean",
    "text_features_closest", "k_closest_articles", "tfidf_long", "venue_tfidf", "extract_coordinates", "region_articles",
    "strip_markup", "encode_text", "regression_metrics", "cross_validation", "soos_validation", "fit_svr_rff", "feature_sweep",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from placelens.plans import all_queries
    from placelens.session import drop_stages, get_session
    spark = get_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="placelens-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, cold = all_queries(), {}, {}

    def run(name):
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.time() - start, 3)
        drop_stages(spark)
        return took

    for name in sys.argv[1:] or HEADLINE:
        cold[name] = run(name)   # code generation and JIT
        warm = sorted(run(name) for _ in range(3 if cold[name] < 4 else 1))
        times[name] = warm[len(warm) // 2]
        print(name, "cold", cold[name], "warm", times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
                      "spark": spark.version, "shuffle_partitions": cpus}))


if __name__ == "__main__":
    main()
