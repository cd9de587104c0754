import random

import pytest

from pairlens.llm import components as c
from pairlens.llm.common import Scratch


@pytest.mark.parametrize("block", [10**6, 40])
def test_components_match_union_find(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_LINKS", block)
    rng = random.Random(block)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4900, 4990)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {i: root(i) for i in list(parent)}
    alone = {i for i in want if all(i not in (a, b) or a == b for a, b in links)}
    got = c.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "t").collect()
    assert {r.node: r.component for r in got} == {i: r for i, r in want.items() if i not in alone}
    assert len(got) == len({r.node for r in got})


def test_no_links(spark):
    assert c.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "t").collect() == []
