import random

from nearkey.llm.components import connected_components


def plain(edges):
    label = {x: x for e in edges for x in e if None not in e}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    return {k: v for k, v in label.items() if any(k in e and e[0] != e[1] and None not in e for e in edges)}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == plain(edges)


def test_components(spark):
    rng = random.Random(2)
    chain = list(range(40))
    rng.shuffle(chain)
    hub = [(100, 101 + i) for i in range(30)]
    loose = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    check(spark, list(zip(chain, chain[1:])) + hub + hub[:3] + [(b, a) for a, b in hub[:2]] + loose + [(300, 300), (None, 5), (-4, 300)])


def test_no_components(spark):
    check(spark, [])
    check(spark, [(1, 1), (None, 2)])
