"""Ranks of pages whose links are put together in rows."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import rank
from siftwell.plans import catalog


def test_steps_join_rows_of_many_links(spark, monkeypatch):
    """A hub of 2,000 links is a few rows for a step; results are those of a row for each link."""
    kept = []
    monkeypatch.setattr(rank, "cut", lambda df, cut=rank.cut: kept.append(cut(df)) or kept[-1])
    spokes = spark.range(2000).select(F.lit("hub").alias("src"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("dst"))
    edges = spokes.union(spokes.select("dst", "src")).union(spokes.where("dst = 's7'"))
    found = {r.id: r.rank for r in rank.pagerank(edges, 2, "reference").collect()}
    sizes = {r.src: r.n for r in kept[0].groupBy("src").count().withColumnRenamed("count", "n").where("src in ('hub', 's7')").collect()}
    assert sizes["s7"] == 1 and 2 <= sizes["hub"] <= 5
    assert len(found) == 2001 and abs(found["hub"] - 1) < 1e-9 and abs(found["s7"] - 2000 * 2 / 2001) < 1e-9 and abs(found["s8"] - 2000 / 2001) < 1e-9


def test_links_move_once(spark, monkeypatch):
    """Links are counted and put together in slices: one exchange, no aggregation of links; slices change nothing."""
    edges = spark.range(3000).select((F.col("id") % 7).alias("src"), (F.col("id") * 5 % 11).alias("dst")).union(spark.createDataFrame([(None, 1), (2, None)], "src long, dst long"))
    found = rank.gathered(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Sort" not in plan
    want = {(r.src, r.dst): r.n for r in edges.where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n")).collect()}
    for size, together in ((2 << 20, 500), (100, 3)):
        monkeypatch.setattr(rank, "SLICE", size)
        monkeypatch.setattr(rank, "TOGETHER", together)
        kept = rank.gathered(edges).collect()
        assert all(len(r.out) <= together and r.n == sum(x.n for x in r.out) for r in kept)
        sums = {}
        for r in kept:
            for x in r.out:
                sums[r.src, x.dst] = sums.get((r.src, x.dst), 0) + x.n
        assert sums == want


def test_links_meet_no_degree(spark, monkeypatch):
    """What is laid out for the steps went through one exchange, and degrees come from it: no window over rows of links."""
    told = []
    monkeypatch.setattr(rank, "cut", lambda df, cut=rank.cut: told.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.range(3000).select((F.col("id") % 7).alias("src"), (F.col("id") * 5 % 11).alias("dst"))
    for iterations in (0, 1):
        found = {r.id: r.rank for r in rank.pagerank(edges, iterations, "reference").collect()}
        assert len(found) == (11 if iterations else 7) and abs(sum(found.values()) - 7) < 1e-9
    assert told[0].count("Exchange") == 1 and "Window" not in told[0]


@pytest.mark.parametrize("large", [False, True])
def test_part_ranks_by_numbers(spark, tmp_path, monkeypatch, large):
    """Ids of the search's ranks are numbers, unless a key is too large for that; ranks are those of texts."""
    rows = [(i % 13, i * i % 5) for i in range(90)] + [(4, 4), (4, 4), (None, 1), (3, None), (None, None), (-2, -1), (0, -1), (2**40, 2**50), ((1 << 62) - 1, -(1 << 62))]
    rows += [(2**62 + 1, 3), (2, 2**63 - 1), (-(2**63), 2)] * large
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = rank.pagerank(catalog.part_edges(spark, str(tmp_path)), 3).where("id like 'p%'").collect()
    kinds = []
    monkeypatch.setattr(rank, "pagerank", lambda edges, *a, pagerank=rank.pagerank: kinds.append(edges.schema["src"].dataType.simpleString()) or pagerank(edges, *a))
    found = sorted((r.id, round(r.rank, 9)) for r in catalog.part_ranks(spark, str(tmp_path), 3).collect())
    assert found == sorted((int(r.id[1:]), round(r.rank, 9)) for r in texts) and len(found) == 16 + 2 * large
    assert kinds == ["string" if large else "bigint"]
