"""Parallel rounds against the sequences they stand for."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertiplan.operators import regions as R
from vertiplan.plans import api
from vertiplan.sources.osm import CityCatalog
from vertiplan.streaming.demand import windowed_demand

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_taking_turns(spark, seed):
    rng = random.Random(seed)
    pairs = [(c, x, float(rng.randint(1, 6))) for c in range(6) for x in range(15) if rng.random() < 0.6]
    taken, want = set(), []
    for c in range(6):
        own = sorted((k, x) for cc, x, k in pairs if cc == c and x not in taken)[:3]
        taken |= {x for _, x in own}
        want += [(c, x) for _, x in own]
    got = R.claim(spark.createDataFrame(pairs, "cluster long, candidate long, km double"), 3)
    assert sorted((r.cluster, r.candidate) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_the_sequence(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, float(rng.randint(1, 5))) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.5]
    n, want = dict.fromkeys(range(12), 0), []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if n[a] < 2 and n[b] < 2:
            n[a], n[b] = n[a] + 1, n[b] + 1
            want.append((a, b))
    got = R.matching(spark.createDataFrame(edges, "a long, b long, weight double"), 2)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    assert R.matching(spark.createDataFrame([], "a long, b long, weight double"), 2).count() == 0


def test_repacked_regions(spark):
    c = [(i, 100.0 - i, 37 + i * 0.01, 55.0) for i in range(12)]
    got = {r.cluster: r.region for r in R.repack(spark.createDataFrame(c, "cluster long, weight double, lon double, lat double")).collect()}
    assert [got[i] for i in range(12)] == ["nearest_0"] * 5 + ["nearest_1"] * 5 + ["nearest_2"] * 2


def test_loops_are_cut():
    assert R.without_loops([(0, 0), (2, 0), (2, 2), (1, 2), (1, -1)]) == [(0, 0), (1.0, 0.0), (1, -1)]
    assert R.without_loops([(0, 0), (0, 0), (1, 1)]) == [(0, 0), (1, 1)]


def test_interior_points(spark):
    ring = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    rows = [(1, 0, 0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    r = R.interior_points(spark.createDataFrame(rows, "k long, part_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"), "k").first()
    assert (r.lon, r.lat) == (0.5, 2.0)


def test_api(spark, tmp_path):
    assert api.city_map(spark, SMALL)["boundary"].count() >= 2
    assert set(api.buildings_export(spark, SMALL)) == {"buildings", "flight_levels", "height_stats"}
    clusters = api.demand_clusters(spark, SMALL)
    assert clusters.count() > 0 and clusters.agg(F.max("weight")).first()[0] <= 10_000
    with pytest.raises(ValueError):
        api.demand_clusters(spark, SMALL, method="other")
    paths = api.local_paths(spark, SMALL)
    assert [n >= m for n, m in itertools.pairwise([paths[3].count(), paths[2].count(), paths[1].count()])] == [True, True]
    catalog = CityCatalog(spark, f"file://{tmp_path}", city="x")
    api.save({"map": api.city_map(spark, SMALL)["no_fly_zones"]}, catalog)
    assert api.load_saved(catalog, ("map", "none"))["map"].count() == 4 and api.load_saved(catalog, ("none",))["none"] is None


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    q = windowed_demand(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), late="3650 days").writeStream.format("memory").queryName("demand").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("demand").agg(F.sum("n")).first()[0] == events.count()


def test_packing_takes_the_nearest_of_those_left():
    rng = np.random.default_rng(3)
    lattice = np.array([(36.8 + i * 0.04, 55.2 + j * 0.03) for i in range(32) for j in range(40)])
    over_pole = np.stack([rng.uniform(36, 37, 400), rng.uniform(80, 100, 400)], axis=1)
    for p in (lattice, rng.normal(size=(700, 2)) * [0.1, 0.05] + [37, 55], over_pole, np.repeat(lattice[:9], 30, axis=0), lattice[:3]):
        ids, (lon, lat) = rng.permutation(len(p)), np.radians(p).T
        want, free = np.full(len(p), -1), list(range(len(p)))
        for r in range(len(p)):
            if not free:
                break
            f, i = np.array(free), free[0]
            a = np.sin((lat[f] - lat[i]) / 2) ** 2 + np.cos(lat[f]) * np.cos(lat[i]) * np.sin((lon[f] - lon[i]) / 2) ** 2
            want[f[np.lexsort((ids[f], np.round(a, 15)))[:5]]] = r
            free = [k for k in free if want[k] < 0]
        assert (R.packed(ids, p[:, 0], p[:, 1], 5) == want).all()


def test_a_city_of_more_clusters_than_before(spark):
    c = spark.range(50_001).selectExpr("id as cluster", "cast(id % 977 as double) as weight", "36.8e0 + id % 32 * 0.04e0 as lon", "20 + floor(id / 32) * 0.03e0 as lat")
    assert R.repack(c).groupBy("region").count().groupBy("count").count().count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_rounds_of_a_matching_equal_one_task(spark, seed):
    rng = random.Random(seed)
    edges = spark.createDataFrame([(a, b, float(rng.randint(1, 5))) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.6], "a long, b long, weight double")
    got = [sorted((r.a, r.b) for r in R.matching(edges, 2, n).collect()) for n in (0, 20, 1000)]
    assert got[0] == got[1] == got[2]


def test_claims_move_the_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(R, "checkpointed", lambda df: pytest.fail("pairs are written again"))
    # every cluster wants what the one before it took: a chain of as many rounds as clusters
    pairs = spark.range(60).selectExpr("id as cluster", "explode(sequence(id, id + 3)) as candidate").selectExpr("cluster", "candidate", "cast(candidate - cluster as double) as km")
    got = sorted((r.cluster, r.candidate) for r in R.claim(pairs.repartition(5), 2).collect())
    assert got[:4] == [(0, 0), (0, 1), (1, 2), (1, 3)] and len({x for _, x in got}) == len(got) == 63
