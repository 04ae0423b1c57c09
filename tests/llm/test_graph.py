import random

from ruleloom.llm.graph import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(root))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5000) for i in range(1, 50)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + edges[:20]
    edges = [(a, b) for a, b in edges if a != b]
    r.shuffle(edges)
    for parts in (1, 7):
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
        assert sorted(map(tuple, found)) == plain(edges)
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_a_star_takes_few_tasks(spark):
    """Edges that are stars once the files are read need no rounds: the driver keeps an entry for every task of them."""
    edges = spark.createDataFrame([(1, i) for i in range(2, 400)], "a long, b long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("stars", "")
    try:
        assert components(edges).count() == 399
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(j).stageIds}
        assert sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= 150
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
