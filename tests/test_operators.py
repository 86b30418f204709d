"""Relational operators: order invariance, bounds, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from twinframe.operators import blocks, buckets, content, graph, groups
from twinframe.plans import tables


def test_content_edges_do_not_depend_on_order_or_partitions(spark, sf):
    items = tables.word_items(spark, sf)
    edges = lambda d: sorted(map(tuple, content.content_edges(d, d.filter(F.size("tokens") >= 4)).collect()))
    first = edges(items)
    assert first and first == edges(items.orderBy(F.rand(1)).repartition(7))
    assert content.content_edges(items.limit(0), items.limit(0)).count() == 0


def test_frequent_tokens_do_not_make_pairs(spark):
    rows = [("g", i, ["common", f"only{i}"]) for i in range(40)] + [("g", 100 + i, ["x", "y", "z", "w"]) for i in range(3)]
    d = spark.createDataFrame(rows, "group string, id long, tokens array<string>")
    assert {(r.a, r.b) for r in content.shared_rare(d, d, 16, 1).collect()} == {(100, 101), (100, 102), (101, 102)}


def test_bounded_components(spark):
    edges = [(i, i + 1, 1.0 - i / 100) for i in range(10)] + [(50, 51, 0.5)]
    rows = graph.bounded_components(spark.createDataFrame(edges, "a long, b long, weight double"), 4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.component, set()).update((r.a, r.b))
    assert sizes == {0: {0, 1, 2, 3}, 4: {4, 5, 6, 7}, 8: {8, 9, 10}, 50: {50, 51}}


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)
    assert {r.root for r in graph.components(chain).collect()} == {0}


def test_bucket_limits(spark):
    keys = spark.createDataFrame([("c", "k", i, i) for i in range(50)] + [("c", "k", 0, 0)], "cluster string, key string, member long, place long")
    assert buckets.bucket_pairs(keys, 32).count() == 32 * 31 // 2 and buckets.bucket_cuts(keys, 32).first().cut == 18


def brute_runs(units, width, max_df):
    wins = {}
    for u, keys in units.items():
        for i in range(len(keys) - width + 1):
            wins.setdefault(tuple(keys[i : i + width]), []).append((u, i))
    out = set()
    for hits in wins.values():
        if 1 < len({u for u, _ in hits}) <= max_df:
            for a, i in hits:
                for b, j in hits:
                    if a < b:
                        x, y = i, j
                        while x and y and units[a][x - 1] == units[b][y - 1]:
                            x, y = x - 1, y - 1
                        n = 0
                        while x + n < len(units[a]) and y + n < len(units[b]) and units[a][x + n] == units[b][y + n]:
                            n += 1
                        out.add((a, x, b, y, n))
    return out


def test_maximal_runs_equal_brute_force(spark):
    r = random.Random(4)
    units = {i: [r.choice("abcde") for _ in range(r.randint(0, 14))] for i in range(12)}
    d = spark.createDataFrame([("g", i, k) for i, k in units.items()], "group string, unit long, keys array<string>")
    w = blocks.windows(d, 3)
    got = {(x.a, x.a_start, x.b, x.b_start, x.length) for x in blocks.maximal_runs(d, blocks.seeds(w, blocks.rare_windows(w, 4))).collect()}
    assert got == brute_runs(units, 3, 4) and got


def test_overlap_removal_keeps_the_longest(spark):
    d = spark.createDataFrame([("b", 1, 0, 5), ("b", 1, 3, 9), ("b", 1, 12, 2), ("b", 2, 0, 5), ("c", 1, 0, 5)], "block string, unit long, start int, length int")
    assert {tuple(x) for x in blocks.without_overlaps(d).collect()} == {("b", 1, 3, 9), ("b", 1, 12, 2), ("b", 2, 0, 5), ("c", 1, 0, 5)}


def test_subsumption_and_equivalents(spark):
    rows = [(1, ["a", "b", "c"], 1, 0), (2, ["a", "b"], 1, 0), (3, ["a", "b"], 1, 2), (4, ["a", "d"], 1, 0), (5, ["a", "b"], 2, 0), (6, ["c", "b", "a"], 1, 1)]
    d = spark.createDataFrame(rows, "key long, members array<string>, kind long, rank int")
    assert {r.key for r in groups.without_subsumed(d, "key", "members", ["kind"], "rank").collect()} == {1, 4, 5, 6}
    assert {r.key for r in groups.equivalents(d, "members", [F.col("rank"), F.col("key")]).collect()} == {1, 2, 4}


def test_ranks_ids_and_zero_counts(spark):
    d = spark.range(1000).withColumn("x", F.col("id") % 7)
    ranks = groups.ranked(d, [F.desc("x"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001)) and [r.id for r in ranks] == [r.id for r in sorted(d.collect(), key=lambda r: (-r.x, r.id))]
    ids = [r.id2 for r in groups.stable_ids(d.filter("id < 20"), "p_", ["x"], ["id"], "id2").orderBy("id").collect()]
    assert len(set(ids)) == 20 and ids[7] == ids[0] + "-2" and ids[14] == ids[0] + "-3"
    assert {r.label: r.n for r in groups.zero_filled_counts(d.withColumn("x", F.col("x").cast("string")), "x", ("0", "nine")).collect()} == {"0": 143, "nine": 0}


def test_queries_have_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = tables.queries(), entry.oracle_sql()
    assert set(queries) - set(sql) == {"shared_blocks", "bounded_components"}

    def plain(rows):
        return sorted(repr([float(f"{v:.10g}") if isinstance(v, float) else v for v in r]) for r in rows)

    for name in ("content_edges", "maximal_runs", "bucket_pairs", "ranked_findings", "subsumed_anti_join", "name_similarity", "mean_jaccard_by_key", "file_selection", "detection_ladder", "fit_score", "risk_score", "noisy_or_payoff", "review_tier", "semantic_cap"):
        d = queries[name](spark, sf)
        columns = sorted(d.columns)
        got = plain(tuple(r) for r in d.select(*columns).collect())
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == plain(con.execute(f"SELECT {quoted} FROM ({sql[name]})").fetchall()), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_ranks_at_any_number_of_partitions(spark):
    from twinframe.operators import groups

    d = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 11).alias("x"))
    want = {r: i + 1 for i, r in enumerate(sorted((i * 37 % 11, -i) for i in range(500)))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {(r.x, -r.id): r["rank"] for r in groups.ranked(d, [F.col("x"), F.desc("id")]).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
