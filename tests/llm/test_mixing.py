import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm.mixing import mix, mixed_documents, permuted, settle_shares, share_report
from docloom.llm.tokens import encoder


def test_settled_shares():
    assert settle_shares({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    assert settle_shares({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100) == {"a": 10, "b": 54, "c": 36}
    assert settle_shares({"a": 0.5, "gone": 0.5}, {"a": 1000}, 100) == {"a": 100, "gone": 0}
    assert settle_shares({"a": 0.5, "b": 0.5}, {"a": 10, "b": 5}, 100) == {"a": 10, "b": 5}
    assert settle_shares({}, {}, 10) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    seen = set()
    for key in range(4):
        p = permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(p) == list(range(n))
        seen.add(tuple(p))
    assert n < 5 or len(seen) == 4


def test_mix(spark):
    rng = random.Random(1)
    docs = []
    for i in range(1200):
        s = rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny", "unlisted", None])
        docs.append((i, s, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(0, 80)))))
    docs += [(5000, "big", None), (5001, "big", ""), (5002, "tiny", "word " * 700)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, block_no int")
    targets = spark.createDataFrame([("big", 0.4, 2), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.1, 4), ("mid", 0.3, 2)], "source string, target_share double, max_repeats int")
    kw = dict(item_id="doc_id", source="source", text="text", block=32, slots_per_shard=64)
    pieces = mix(df, targets, **kw)
    rows = pieces.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(df, targets, **kw).collect()))  # same seed, same mix
    size = {i: len(encoder().encode_ordinary(t or "")) for i, _, t in docs}
    source = {i: s for i, s, _ in docs}
    caps = {"big": 2, "mid": 2, "tiny": 3}
    use = defaultdict(Counter)
    for r in rows:
        assert source[r.item_id] == r.source and 0 <= r.token_from < r.token_to <= size[r.item_id]
        for t in range(r.token_from, r.token_to):
            use[r.item_id][t] += 1
    assert all(max(c.values()) <= caps[source[i]] for i, c in use.items())
    blocks = defaultdict(int)
    for r in rows:
        blocks[r.shard, r.slot] += r.token_to - r.token_from
    assert max(blocks.values()) == 32 and sum(v < 32 for v in blocks.values()) <= 3 * 3
    total = sum(n for i, n in size.items() if source[i] in caps)
    assert abs(sum(blocks.values()) - total) < 200
    got = Counter()
    for r in rows:
        got[r.source] += (r.token_to - r.token_from) / sum(blocks.values())
    tiny = 3 * sum(n for i, n in size.items() if source[i] == "tiny") / total
    assert got["tiny"] <= tiny + 0.01
    if tiny > 0.25:
        assert abs(got["big"] - 0.4 / 0.9) < 0.05
    docs_out = {r.item_id: r for r in mixed_documents(pieces).collect()}
    assert all(docs_out[i].repeats == max(c.values()) and docs_out[i].n_tokens == sum(c.values()) for i, c in use.items())
    report = {r.source: r for r in share_report(pieces, targets).collect()}
    assert set(report) == {"big", "mid", "tiny", "none"} and report["none"].actual_share == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and abs(report["big"].actual_share - got["big"]) < 1e-9


def test_scarce_source_is_used_up_to_its_cap(spark):
    df = spark.createDataFrame([(i, "small" if i < 20 else "large", "one two three four " * 8) for i in range(900)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("small", 0.5, 3), ("large", 0.5, 2)], "source string, target_share double, max_repeats int")
    pieces = mix(df, targets, item_id="doc_id", source="source", text="text", block=16, slots_per_shard=100)
    docs = mixed_documents(pieces).collect()
    small = [d for d in docs if d.source == "small"]
    assert len(small) == 20 and all(d.repeats == 3 for d in small)
    assert all(d.repeats <= 2 for d in docs if d.source == "large")


@pytest.mark.parametrize("total", [3200, 3216, 2000])
def test_every_slot_is_placed_where_the_caps_bind(spark, total):
    """Rooms of 100, 60 and 41 blocks of 16 tokens: all of it wanted, as near as makes no difference, and less."""
    n = {"a": 100, "b": 30, "c": 41}
    text = " ".join(["one"] * 16)
    df = spark.createDataFrame([(i * 1000 + j, s, text) for i, (s, k) in enumerate(n.items()) for j in range(k)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    rows = mix(df, targets, item_id="doc_id", source="source", text="text", block=16, slots_per_shard=50, total_tokens=total).collect()
    assert len({(r.shard, r.slot) for r in rows}) == total // 16 and sum(r.token_to - r.token_from for r in rows) == total
    uses = Counter(r.item_id for r in rows)
    assert max(uses[i] for i in uses if i < 1000) == 1 and max(uses[i] for i in uses if 1000 <= i < 2000) <= 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(df, targets, item_id="doc_id", source="source", text="text").count() == 0
    assert [tuple(r) for r in share_report(mix(df, targets, item_id="doc_id", source="source", text="text"), targets).collect()] == [("a", 1.0, 0.0, 0, 1)]
    assert mix(df, targets.limit(0), item_id="doc_id", source="source", text="text").count() == 0
