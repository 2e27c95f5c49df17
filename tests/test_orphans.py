import random
from datetime import datetime, timedelta, timezone

import pytest

from docloom.operators.orphans import orphan_references, orphans_by_period

T0 = datetime(2024, 1, 30, tzinfo=timezone.utc)


def brute(refs, parents):
    out = set()
    for i, k, at in refs:
        if k is None:
            continue
        if at is None or not any(pk == k and s is not None and s <= at and (e is None or at < e) for pk, s, e in parents):
            out.add((i, at and at.strftime("%Y-%m")))
    return out


def run(spark, refs, parents, key="long", **kw):
    r = spark.createDataFrame([(*x, "x", 1) for x in refs], f"id long, ref {key}, ingested_at timestamp, start string, end int")
    p = spark.createDataFrame([(*x, "y") for x in parents], f"key {key}, born timestamp, gone timestamp, row_id string")
    df = orphan_references(r, p, ref_table="refs", ref_key="ref", parent_key="key", valid_from="born", valid_to="gone", **kw)
    got = [(x.row_id, x.period) for x in df.collect()]
    assert len(got) == len(set(got))
    return set(got), df


@pytest.mark.parametrize("key", ["long", "string"])
@pytest.mark.parametrize("rows_per_range,rows_per_batch", [(10_000, 10_000), (7, 11)])
def test_against_brute_force(spark, key, rows_per_range, rows_per_batch):
    rng = random.Random(5)
    cast = (lambda v: v) if key == "long" else (lambda v: f"k{v}é")
    day = lambda: T0 + timedelta(hours=rng.randrange(2000))
    parents = [(cast(rng.choice([3, 3, 3, *range(30)])), day(), None) for _ in range(20)]
    for _ in range(80):
        a = day()
        parents.append((cast(rng.choice([3, 3, 3, *range(30)])), a, a + timedelta(hours=rng.randrange(-5, 400))))
    parents += [(None, T0, None), (cast(4), None, None), parents[0], parents[0]]
    refs = [(i, cast(rng.choice([3, 3, *range(40)])), day()) for i in range(400)]
    refs += [(1000, None, T0), (1001, cast(3), None), (1002, cast(77), None), refs[0], refs[0], (0, cast(39), T0 + timedelta(days=300))]
    got, _ = run(spark, refs, parents, key, rows_per_range=rows_per_range, rows_per_batch=rows_per_batch)
    assert got == brute(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [])[0] == set()
    assert run(spark, [], [(1, T0, None)])[0] == set()
    got, df = run(spark, [(1, 5, T0), (2, None, T0)], [])
    assert got == {(1, "2024-01")}
    assert [tuple(x) for x in orphans_by_period(df).collect()] == [("refs", "2024-01", 1)]


def test_interval_ends(spark):
    hour = timedelta(hours=1)
    refs = [(1, 5, T0), (2, 5, T0 + hour), (3, 5, T0 - hour)]
    assert run(spark, refs, [(5, T0, T0 + hour)])[0] == {(2, "2024-01"), (3, "2024-01")}
