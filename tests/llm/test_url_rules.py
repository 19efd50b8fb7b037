"""Mined rules where URLs have more tokens than FP-growth takes, against all sets of tokens."""

import random
from itertools import combinations

from tessera.llm import url_filter


def brute(rows, support, confidence):
    least = max(1, -int(-support * len(rows) // 1))
    names = sorted({x for t, _ in rows for x in t})
    rules = {}
    for k in range(1, len(names) + 1):
        for s in combinations(names, k):
            if any(set(r) <= set(s) for r in rules):
                continue
            held = [b for t, b in rows if set(s) <= set(t)]
            if sum(held) >= least and sum(held) / len(held) >= confidence:
                rules[s] = (sum(held) / len(held), sum(held))
    return rules


def test_rules_of_long_urls_are_whole(spark):
    r = random.Random(1)
    rows = [(r.sample("abcdefg", r.choice((1, 2, 2, 3, 6))), r.random() < 0.45) for _ in range(60)]
    want = brute(rows, 0.05, 0.55)
    assert {len(s) for s in want} == {2, 3, 4}
    labelled = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    for basket in (4, 0):
        got = url_filter.mine(labelled, 0.05, 0.55, basket).collect()
        assert {tuple(x["items"]): (x.confidence, x.blocked) for x in got} == want and len(got) == len(want)


def test_many_tokens_that_go_together(spark):
    """Thirty tokens of one host, half of it blocked: no rule but with the path that is."""
    host = [f"h:{i:02d}" for i in range(30)]
    rows = [(host + ["p:bad"], True)] * 3 + [(host + ["p:good"], False)] * 3 + [(["h:other"], False)] * 4
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.1, 0.6).collect()
    assert [(x["items"], x.blocked) for x in got] == [(["p:bad"], 3)]
