"""The rollup of all measures has its percentiles, and they are exact whatever the sketches say."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from rivulet.operators import rollup
from rivulet.plans import catalogue, events
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def test_stats_rollup_has_exact_percentiles(spark):
    assert set(rollup.PERCENTILES) <= set(connect(SF).execute(catalogue.oracle_sql()["stats_rollup"]).df().columns)
    got = {(r.period_key, r.tier, r.provider): r for r in catalogue.queries()["stats_rollup"](spark, SF).filter("grain = 'day' AND dimension = 'provider'").collect()}
    raw = pd.read_parquet(f"{SF}/events.parquet")
    raw = raw.assign(day=raw.ts.dt.strftime("%Y-%m-%d"), tier=[events.TIERS[u % 3] for u in raw.user_id], provider=[events.PROVIDERS[u % 4] for u in raw.user_id])
    groups = raw.groupby(["day", "tier", "provider"])
    assert set(got) == set(groups.groups)
    for key, rows in groups:
        want = [np.quantile(rows.value / by, q) for by in (1, 2) for q in (0.5, 0.95)]
        assert [got[key][n] for n in rollup.PERCENTILES] == pytest.approx(want, abs=2e-8), key


@pytest.mark.parametrize("size", [400, 8])
def test_exact_percentiles_need_no_good_sketch(spark, monkeypatch, size):
    monkeypatch.setattr(rollup, "EDGE_SKETCH", size)
    random, start = np.random.default_rng(7), datetime(2024, 1, 1)
    hot = [(start + timedelta(minutes=i % 1440), "Go", "a", "m", "US", float(random.choice([random.normal(), round(random.normal()), 5])), None if i % 3 else i) for i in range(5000)]
    rows = [*hot, (start, "Go", "b", "m", "DE", None, None), (start, "Paid", "a", "n", None, 4.0, 2), (start, "Free", "a", "n", "FR", 1.0, 7), (start, "Free", "a", "n", "FR", 2.0, None)]
    df = spark.createDataFrame(rows, "event_time timestamp, tier string, provider string, model string, country string, duration_ms double, ttfb_ms long")
    got = {(r.grain, r.dimension, r.tier, r.provider, r.country): r for r in rollup.exact_percentiles(df).collect()}
    assert len(got) == 2 * 4 * 4  # two grains, four sets, four groups in each
    quantiles = lambda values: [None if not values else pytest.approx(np.quantile(values, q), abs=1e-12) for q in (0.5, 0.95)]
    for grain in ("day", "week"):
        for dimension, provider, country in (("provider", "a", None), ("model", "a", None), ("geo", "all", "US"), ("geo_model", "a", "US")):
            r = got[grain, dimension, "Go", provider, country]
            assert [r[n] for n in rollup.PERCENTILES] == [*quantiles([h[5] for h in hot]), *quantiles([h[6] for h in hot if h[6] is not None])]
        assert [got[grain, "provider", "Go", "b", None][n] for n in rollup.PERCENTILES] == [None] * 4
        assert [got[grain, "geo", "Paid", "all", None][n] for n in rollup.PERCENTILES] == [4.0, 4.0, 2.0, 2.0]
        assert [got[grain, "geo", "Free", "all", "FR"][n] for n in rollup.PERCENTILES] == [1.5, pytest.approx(1.95), 7.0, 7.0]
