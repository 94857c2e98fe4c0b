import numpy as np

from tidemark.llm.mix import fly, mix, plan_weights, shares

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    pi, tokens = rng.uniform(0.1, 0.9, 400), rng.integers(1, 500, 400).astype(float)
    out = fly(np.full(400, 0.37), tokens, np.random.default_rng(1), False)
    left = (out > 0) & (out < 1)
    assert left.sum() <= 2
    assert abs(out.sum() - 0.37 * 400) < 1e-6 and abs((out * tokens).sum() - 0.37 * tokens.sum()) < 1e-4
    landed = fly(pi, tokens, np.random.default_rng(1), True)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed.sum() - pi.sum()) <= 1.5
    assert set(np.unique(fly(np.full(5, 0.5), np.ones(5), np.random.default_rng(1), True))) <= {0.0, 1.0}


def test_inclusion_is_fair():
    runs = np.mean([fly(np.full(12, 0.25), np.arange(1.0, 13), np.random.default_rng(s), True) for s in range(1500)], axis=0)
    assert np.abs(runs - 0.25).max() < 0.05


def test_weights():
    w = plan_weights({"a": (10, 100), "b": (10, 100), "c": (0, 0)}, [("a", 0.5, 1), ("b", 0.25, 4), ("c", 0.2, 4), ("d", 0.1, 9)])
    assert w == {"a": 1.0, "b": 0.5}
    assert plan_weights({}, []) == {} and plan_weights({"a": (1, 10)}, [("a", 1.0, 2)], total=1e9) == {"a": 2.0}


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), "big") for i in range(600)] + [(1000 + i, "small text here", " Small-Set ") for i in range(40)] + [(5000, None, "big"), (5001, "", "big"), (5002, "x", None), (5003, "x", "other")]
    d = spark.createDataFrame(docs, DOCS)
    t = spark.createDataFrame([("big", 0.6, 2), ("small set", 0.2, 3), ("absent", 0.2, 3), (None, 0.1, 1)], TARGETS)
    m = mix(d, t, group=50)
    rows = m.collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in mix(d.repartition(7), t, group=50).collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.copies <= (2 if r.source == "big" else 3) for r in rows)
    s = {r.source: r for r in shares(m, t).collect()}
    assert abs(s["big"].actual_share - 0.75) < 0.02 and abs(s["small_set"].actual_share - 0.25) < 0.02 and s["absent"].tokens == 0
    assert mix(d.limit(0), t).count() == 0 and mix(d, t.limit(0)).count() == 0
