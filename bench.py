"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is timed
to its full result; the cross-join form of rule matching is timed alongside for
the ratio the keyed form gains.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ruleloom.catalog import datasets as D  # noqa: E402
from ruleloom.catalog.queries import QUERIES, setup  # noqa: E402
from ruleloom.functions.membership import membership_vector  # noqa: E402
from ruleloom.operators.encode import CLASS, encode, own_labels, x_col  # noqa: E402
from ruleloom.session import build_session  # noqa: E402

HEADLINE = {
    "profile": "feature_profile",
    "learn_global": "rules_cf",
    "learn_chunked": "rules_chunked",
    "learn_lineitem": "lineitem_rules",
    "learn_lineitem_five_labels": "lineitem_rules_five_labels",
    "learn_wide_6": "order_line_rules",
    "learn_wide_64": "embedding_rules_64",
    "predict_wide_64": "predict_embeddings_64",
    "predict_wr": "predict_wr",
    "predict_ac": "predict_ac",
    "predict_multiclass": "predict_multiclass",
    "classify_lineitem": "lineitem_confusion",
    "cross_validate": "cross_validate",
    "ga_fitness": "ga_fitness",
    "ga_generation": "ga_select",
    "rule_text": "rule_text",
}


#: The table whose rows a query reads, where it isn't the events.
TABLE = {
    "profile": "events",
    "learn_lineitem": "lineitem",
    "learn_lineitem_five_labels": "lineitem",
    "learn_wide_6": "lineitem",
    "learn_wide_64": "embeddings",
    "predict_wide_64": "embeddings",
    "predict_multiclass": "orders",
    "classify_lineitem": "lineitem",
    "rule_text": "documents",
}


def cross_join_support(spark, sf_dir):
    """Support of the lineitem rules by rows x rules, for comparison only."""
    df, schema = setup(spark, sf_dir, D.LINEITEM)
    rows = encode(df, schema)
    n = schema.n_labels
    labels = own_labels(schema)
    mus = [
        membership_vector(F.col(x_col(i)), v, n).alias(f"mu{i}") if v.is_numeric else F.col(x_col(i)).alias(f"mu{i}")
        for i, v in enumerate(schema.variables)
    ]
    data = rows.select(CLASS, *mus)
    rules = rows.select(*[c.alias(f"a{i}") for i, c in enumerate(labels)]).distinct()
    degree = F.lit(1.0)
    for i, v in enumerate(schema.variables):
        a = F.col(f"a{i}")
        degree = degree * (F.get(F.col(f"mu{i}"), a) if v.is_numeric else (F.col(f"mu{i}") == a).cast("double"))
    pairs = data.crossJoin(F.broadcast(rules)).withColumn("d", degree).filter("d > 0")
    return pairs.groupBy(*[f"a{i}" for i in range(len(labels))], CLASS).agg(F.sum("d").alias("s"))


def clock(run, times: int = 3) -> float:
    """Median seconds of a few runs."""
    taken = []
    for _ in range(times):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return round(sorted(taken)[times // 2], 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    wanted = os.environ.get("BENCH_QUERIES")
    times, rates = {}, {}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(TABLE.values())}
    for name, query in HEADLINE.items():
        if wanted and name not in wanted.split(","):
            continue
        times[name] = clock(lambda q=query: QUERIES[q](spark, sf_dir))
        rates[name] = round(rows[TABLE.get(name, "events")] / times[name])
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    if not wanted:
        times["cross_join_lineitem"] = clock(lambda: cross_join_support(spark, sf_dir), 1)
    total = round(sum(v for k, v in times.items() if k != "cross_join_lineitem"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "rows_per_sec": rates, "sf": sf}))


if __name__ == "__main__":
    main()
