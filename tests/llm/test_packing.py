import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm.packing import best_fit_plan, fill_report, pack
from docloom.llm.tokens import encoder, rank_within, token_sizes


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed,capacity", [(1, 100), (2, 100), (3, 17), (4, 1)])
def test_plan_is_best_fit(seed, capacity):
    rng = random.Random(seed)
    lengths = [min(capacity, max(1, int(rng.expovariate(1 / 20)))) for _ in range(700)]
    rows = best_fit_plan(Counter(lengths), capacity)
    filled, slots, ranks = defaultdict(int), set(), defaultdict(set)
    for r in rows:
        length, a, b, container, each, position, offset = r
        for k in range(b - a):
            c, at = container + k // each, k % each
            filled[c] += length
            assert (c, position + at) not in slots and a + k not in ranks[length]
            slots.add((c, position + at)), ranks[length].add(a + k)
    assert {n: len(x) for n, x in ranks.items()} == dict(Counter(lengths))
    assert max(filled.values()) <= capacity and set(filled) == set(range(len(filled)))
    assert len(filled) == naive_best_fit(lengths, capacity)


def test_plan_does_not_grow_with_the_items():
    few = {n: 3 + n % 5 for n in range(1, 129)}
    assert len(best_fit_plan({n: c * 1_000_000 for n, c in few.items()}, 128)) < 4 * 128
    with pytest.raises(ValueError):
        best_fit_plan({9: 1}, 8)


@pytest.mark.parametrize("rows_per_bucket", [100_000, 13])
def test_pack_places_everything_once(spark, rows_per_bucket):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "γάμμα", "漢字"]) for _ in range(int(rng.paretovariate(0.9) * 3) % 900)) for _ in range(400)]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, "word " * 5000), (None, "no id"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, container int")
    got = pack(df, item_id="doc_id", text="text", capacity=64, rows_per_bucket=rows_per_bucket).collect()
    size = lambda t: len(encoder().encode_ordinary(t)) if t else 0
    want = Counter()
    for i, t in rows:
        for p in range(-(-size(t) // 64)):
            want[i, p, p * 64, min(64, size(t) - p * 64)] += 1
    assert Counter((r.item_id, r.part, r.token_start, r.n_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.container].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.position)
        assert [r.position for r in b] == list(range(len(b)))
        at = 0
        for r in b:
            assert r.offset == at
            at += r.n_tokens
        assert at <= 64
    assert len(bins) == naive_best_fit([n for (*_, n), c in want.items() for _ in range(c)], 64)
    report = fill_report(pack(df, item_id="doc_id", text="text", capacity=64), 64).first()
    assert report.n_containers == len(bins) and report.n_tokens == sum(k[3] * c for k, c in want.items()) and report.fullest <= 64


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, item_id="doc_id", text="text").count() == 0
    assert token_sizes(df, keys=["doc_id"], text="text").count() == 0


def test_rank_within(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") % 100).alias("k"))
    for per in (7, 1000):
        got = rank_within(df, ["g"], ["k"], "r", per).collect()
        by = defaultdict(list)
        for x in got:
            by[x.g].append(x.r)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500
