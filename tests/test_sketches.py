"""Sketched quantiles against sorted values."""

import math
import random

from songframe.operators import sketches as SK


def test_within_the_stated_error_and_mergeable(spark):
    rng = random.Random(2)
    groups = {
        "wide": [10 ** rng.uniform(-6, 6) for _ in range(900)], "signed": [rng.gauss(0, 5) for _ in range(700)], "few": [3.0], "zeros": [0.0] * 5 + [1.0, -1.0],
        "odd": [1.0, 2.0, math.inf, -math.inf], "none": [None, math.nan],
    }
    rows = [(g, rng.randint(0, 3), x) for g, values in groups.items() for x in values]
    df = spark.createDataFrame(rows, "genre string, shard int, v double").repartition(4)
    whole = SK.sketch(df, ["genre"], "v")
    parts = SK.merged([SK.sketch(df.filter(f"shard = {i}"), ["genre"], "v") for i in range(4)], ["genre"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(whole.columns).collect()))
    wanted = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {(r.genre, r.quantile): r for r in SK.quantiles(parts, ["genre"], wanted).collect()}
    assert {g for g, _ in got} == set(groups) - {"none"}
    for g, values in groups.items():
        kept = sorted(x for x in values if x is not None and x == x)
        for q in wanted if kept else ():
            value = kept[max(1, math.ceil(q * len(kept))) - 1]
            assert got[g, q]["count"] == len(kept)
            assert got[g, q].estimate == value or abs(got[g, q].estimate - value) <= SK.ACCURACY * abs(value) * (1 + 1e-9), (g, q)
    exact = {(r.genre, r.quantile): r.exact for r in SK.exact_quantiles(df.filter("genre in ('wide', 'few')"), ["genre"], "v").collect()}
    assert exact["few", 0.5] == 3.0 and exact["wide", 0.5] == sorted(groups["wide"])[449]
