"""Idle entries of a stream against a plain loop, without Python for each user."""

import random
from datetime import datetime, timedelta

from corpuslens.streaming import keyed as kd
from corpuslens.streaming import windows as st

SCHEMA = "user_id long, ts timestamp_ntz, value double"


def test_idle_entries(spark):
    rng, day = random.Random(3), datetime(2024, 1, 1)
    rows = [(u, day + timedelta(minutes=rng.randint(0, 4000)), rng.choice([None, 0.5, 2.0])) for u in range(20) for _ in range(15)]
    rows += [(50, day, 1.0), (50, day + timedelta(hours=4), 1.0), (51, day, 1.0), (51, day + timedelta(hours=4) - timedelta(microseconds=1), None)]
    rng.shuffle(rows)
    mid = day + timedelta(minutes=2000)
    tardy = lambda r: mid - timedelta(hours=1) < r[1] and r[0] % 2
    parts = [[r for r in rows if r[1] <= mid and not tardy(r)], [r for r in rows if r[1] > mid or tardy(r)]]
    events = spark.createDataFrame(rows, SCHEMA)
    plans = []

    def seen(stream):
        out = kd.idle_entries(stream)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    got = st.run_in_steps(spark, [*(spark.createDataFrame(p, SCHEMA) for p in parts), st.far_end(events)], seen).collect()
    want = {}
    for u, ts, v in sorted(rows, key=lambda r: r[:2]):
        own = want.setdefault(u, [])
        if own and ts < own[-1][1] + timedelta(hours=4):
            own[-1][1:] = [ts, own[-1][2] + 1, own[-1][3] + (v or 0.0)]
        else:
            own.append([ts, ts, 1, v or 0.0])
    got, want = {(r.user_id, r.first_ts, r.last_ts, r.n, r.total) for r in got}, {(u, *x) for u, own in want.items() for x in own}
    assert got == want, (sorted(got - want)[:3], sorted(want - got)[:3])
    assert "InPandas" not in plans[0]
