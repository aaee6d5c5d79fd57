"""Chunked position sets, branches of the trie, and intervals as cells."""

import random

import pytest
from nearkey.functions.intervals import interval_cells, number_cells
from nearkey.operators import index
from nearkey.sources.tables import star_model
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return star_model(spark, SF)


def test_branches(spark):
    words = ["car", "card", "care", "cat", "dog", "dogma", "x", "ab", "abc"]
    found = dict(tuple(r) for r in index.trie_branches(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    for node in {w[:i] for w in words for i in range(1, len(w) + 1)}:
        below = [w for w in words if w.startswith(node)]
        n = max(i for i in range(1, 9) if len({w[:i] for w in below}) == 1 and len(min(below, key=len)) >= i)
        assert found[node] == below[0][:n]


def plain_sets(labels, keywords):
    """{(hub, node): positions} from the postings' own words."""
    words = {}
    for r in keywords.collect():
        words.setdefault(r["vertex"], set()).add(r["word"])
    sets = {}
    for r in index.hub_postings(labels, keywords).collect():
        for node in {w[:i] for w in words[r["vertex"]] for i in range(1, len(w) + 1)}:
            sets.setdefault((r["hub"], node), set()).add(r["pos"])
    return sets


def test_chunks_are_the_positions(model):
    want = plain_sets(model.labels, model.keywords)
    got = {}
    for r in index.hub_node_chunks(model.labels, model.keywords).collect():
        own = {32 * r["chunk"] + i for i in range(32) if r["bits"] >> i & 1}
        assert own and not own & got.get((r["hub"], r["node"]), set())
        got.setdefault((r["hub"], r["node"]), set()).update(own)
    assert got == want
    counts = {(r["hub"], r["node"]): (r["ones"], r["first_pos"], r["last_pos"]) for r in index.hub_node_popcount(model.labels, model.keywords).collect()}
    assert counts == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def ordinary(spark):
    """A network and a dictionary of many words, a few to a vertex."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 12))) for _ in range(900)]
    labels = [(v, h, rng.randint(1, 50)) for v in range(1500) for h in rng.sample(range(40), 5)]
    keywords = {(v, rng.choice(words)) for v in range(1500) for _ in range(3)}
    return spark.createDataFrame(labels, "vertex long, hub long, dist int"), spark.createDataFrame(sorted(keywords), "vertex long, word string")


def shuffled(df):
    """Rows that a plan's exchanges wrote."""
    df.collect()
    total, todo, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_counting_shuffles_less_than_half_of_the_prefixes(spark):
    labels, keywords = ordinary(spark)
    every = index.hub_node(labels, keywords).groupBy("hub", "node").agg(F.count("*").alias("ones"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = index.branch_chunks(labels, keywords).groupBy("hub", "branch").agg(F.sum(F.bit_count("bits")).alias("ones"))
        assert shuffled(counted) < shuffled(every) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_cover_an_interval_once(spark):
    rng = random.Random(5)
    spans = [(0, 0), (0, 15), (0, 16), (1, 16), (15, 16), (16, 31), (255, 256), (0, 2**32 - 1), (7, 6)]
    spans += [tuple(sorted(rng.randrange(1 << bits) for _ in range(2))) for bits in (5, 9, 14) for _ in range(40)]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i long, low long, high long").select("i", F.inline(interval_cells(F.col("low"), F.col("high")))).collect()
    found = {}
    for r in rows:
        found.setdefault(r["i"], []).append((r["cell"] << r["level"], (r["cell"] + 1) << r["level"]))
    for i, (low, high) in enumerate(spans):
        at = low
        for begin, end in sorted(found.get(i, [])):
            assert begin == at
            at = end
        assert at == high + 1 or low > high
        assert len(found.get(i, [])) <= 30 * 8
    cells = spark.range(1).select(F.inline(number_cells(F.lit(0x12345)))).collect()
    assert [(r["level"], r["cell"]) for r in cells][:3] == [(0, 0x12345), (4, 0x1234), (8, 0x123)]


def test_probes_are_joined_by_cells(spark, model):
    probes = spark.createDataFrame([("i", 2, 1, 10**6), ("e", 3, 40, 44), ("e", 3, 44, 40)], "letter string, depth int, low long, high long")
    found = index.level_index_probe(model.keywords, probes)
    nodes = index.trie_intervals(model.keywords).where("node <> ''").collect()
    want = {(p["letter"], p["depth"], p["low"], n["node"], n["id"]) for p in probes.collect() for n in nodes if n["node"][-1] == p["letter"] and len(n["node"]) == p["depth"] and p["low"] <= n["id"] <= p["high"]}
    got = [(r["letter"], r["depth"], r["low"], r["node"], r["id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_cells_are_merged_and_only_those_asked_for(spark, model):
    """Exploded rows are larger than the planner takes them for: they must not be broadcast through the driver."""
    intervals = index.trie_intervals(model.keywords)
    probes = intervals.selectExpr("node as under", "id as low", "last as high", "length(node) + 1 as depth", "'e' as letter")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.level_index_probe(model.keywords, probes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert any("SortMergeJoin" in line and "cell" in line for line in plan.splitlines())


def test_ranks_positions_and_covers_of_many_chunks(spark):
    """Hubs of over 2,048 positions, and a branch that is its node's own parent."""
    rng = random.Random(3)
    words = ["a", "ab", "abcd", "abce", "x", "xyz", "q"]
    keywords = sorted({(v, rng.choice(words)) for v in range(2600) for _ in range(2)})
    labels = [(v, h, rng.randint(1, 9)) for v in range(2600) for h in (0, 1) if h == 0 or v % 50 == 0]
    keywords, labels = spark.createDataFrame(keywords, "vertex long, word string"), spark.createDataFrame(labels, "vertex long, hub long, dist int")
    sets = {k: sorted(v) for k, v in plain_sets(labels, keywords).items()}
    sets |= {(h, ""): list(range(n)) for h, n in ((0, 2600), (1, 52))}
    want = {(h, node, pos, sets[h, node[:-1]].index(pos)) for (h, node), own in sets.items() if node for pos in own}
    assert set(map(tuple, index.rank_in_parent(labels, keywords).select("hub", "node", "pos", "rank").collect())) == want
    got = {(r["hub"], r["node"]): list(r["positions"]) for r in index.hub_node_positions(labels, keywords).collect()}
    assert got == {k: v for k, v in sets.items() if k[1]}
    covers = {(h, node) for h, node in got if not any(g == h and other != node and other.startswith(node) for g, other in got)}
    assert set(map(tuple, index.covering_nodes(labels, keywords).collect())) == covers


def test_prefixes_are_not_broadcast(spark, model):
    """Without run-time statistics the planner takes them for as small as the parts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.hub_node(model.labels, model.keywords)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert not any("BroadcastHashJoin [vertex" in line for line in plan.splitlines())


def test_ranks_are_summed_where_a_hub_is(spark, model):
    """Of the postings' size there is one shuffle, by hub; what follows in the hub's task is not dealt again."""
    from nearkey.plans import registry

    labels = model.labels.count()
    assert shuffled(registry.QUERIES["rank_in_parent"](spark, SF)) < 2 * labels


@pytest.mark.parametrize("hot", [20, 1 << 18])
def test_small_and_hot_hubs_have_the_same_sets_and_ranks(spark, monkeypatch, hot):
    rng = random.Random(3)
    words = ["car", "card", "care", "cat", "dog", "dogma", "x", "ab", "abc"]
    pairs = sorted({(v, h) for h, size in ((0, 150), (1, 30), (2, 5)) for v in range(size)})
    labels = spark.createDataFrame([(v, h, rng.randint(1, 4)) for v, h in pairs], "vertex long, hub long, dist int")
    keywords = spark.createDataFrame(sorted({(v, rng.choice(words)) for v in range(140) for _ in range(3)}), "vertex long, word string")
    monkeypatch.setattr(index, "HOT_ROWS", hot)
    monkeypatch.setattr(index, "SLICE_BITS", 4)
    sets = plain_sets(labels, keywords)
    own = {}
    for r in index.hub_postings(labels, keywords).collect():
        own.setdefault(r["hub"], set()).add(r["pos"])
    want, sums = set(), {}
    for (hub, node), positions in sets.items():
        among = sorted(own[hub] if len(node) == 1 else sets[hub, node[:-1]])
        ranks = {p: among.index(p) for p in positions}
        want |= {(hub, node, p, r) for p, r in ranks.items()}
        sums[hub, node] = (len(ranks), min(ranks.values()), max(ranks.values()), sum(ranks.values()), sum((p + 1) * (r + 1) for p, r in ranks.items()))
    assert set(map(tuple, index.rank_in_parent(labels, keywords).select("hub", "node", "pos", "rank").collect())) == want
    assert {tuple(r)[:2]: tuple(r)[2:] for r in index.rank_sums_in_parent(labels, keywords).collect()} == sums
    assert {(r["hub"], r["node"]): r["positions"] for r in index.hub_node_positions(labels, keywords).collect()} == {k: sorted(v) for k, v in sets.items()}
    assert {(r["hub"], r["node"]): (r["ones"], r["first_pos"], r["last_pos"]) for r in index.hub_node_popcount(labels, keywords).collect()} == {k: (len(v), min(v), max(v)) for k, v in sets.items()}
