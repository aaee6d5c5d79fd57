import inspect

import numpy as np
from nearkey.llm import neighbours, vector_dedup, vectors

from .conftest import SF, rows, same_as_oracle


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1), (50, [0.6, 0.8], 1), (50, [0.6, 0.8], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.02], None), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [-1.0, 0.0], 2), (12, [-2.0, 0.0], 2),
    ]
    return spark.createDataFrame([r + (1, 2.0) for r in data], "vec_id long, embedding array<float>, label int, rank int, score double")


def plain_usable(r):
    return r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])


def cosine(a, b):
    return float(vectors.cosines(np.array([a], float), np.array([b], float))[0])


def check_nearest(df, **options):
    every = [r for r in df.collect() if plain_usable(r)]
    want = []
    queries = {}
    for r in every:
        if r["vec_id"] % 50 == 0:
            queries[r["vec_id"]] = min(r, queries.get(r["vec_id"], r), key=lambda r: r["embedding"])
    for q in queries.values():
        near = sorted((-cosine(q["embedding"], c["embedding"]), c["vec_id"]) for c in every if c["vec_id"] != q["vec_id"] and len(c["embedding"]) == len(q["embedding"]))
        want += [(q["vec_id"], i, v, -s) for i, (s, v) in enumerate(near[:5], 1)]
    assert rows(neighbours.nearest(df, df.where("vec_id % 50 = 0"), **options)) == sorted(want)


def test_nearest_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_nearest(df)
    check_nearest(df, query_block=4, block=60)
    same_as_oracle(neighbours.query(spark, SF), neighbours.ORACLE)


def test_nearest_of_odd_rows(spark):
    df = odd_vectors(spark)
    check_nearest(df)
    again = df.unionByName(spark.createDataFrame([(50, [0.1, 0.9], 1, 1, 2.0), (50, [1.0, 0.0, 0.2], 2, 1, 2.0), (0, [0.5, 0.5], 1, 1, 2.0), (2, [0.3, 0.1], 1, 1, 2.0)], df.schema))
    check_nearest(again)
    check_nearest(again, query_block=1, block=2)
    assert [r["rank"] for r in neighbours.nearest(again, again.where("vec_id = 50")).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert neighbours.nearest(df.limit(0), df).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = vectors.unit(rng.standard_normal((60, 17))), vectors.unit(rng.standard_normal((80, 17)) ** 3)
    (ca, sa, na, ea), (cb, sb, _, eb) = neighbours.quantised(a), neighbours.quantised(b)
    near = (ca.astype(float) @ cb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(a @ b.T - near) <= ea[:, None] + na[:, None] * eb + 1e-12).all()


def plain_dedup(data, least=0.93):
    n = len(data)
    good = [plain_usable(r) and r["label"] is not None for r in data]
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = data[i], data[j]
            if i != j and good[i] and good[j] and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                link[i][j] = cosine(a["embedding"], b["embedding"]) >= least
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i, r in enumerate(data):
        ids = [data[j]["vec_id"] for j in range(n) if label[j] == label[i] and data[j]["vec_id"] is not None]
        out.append((r["vec_id"], sum(link[i]), min(ids) if r["vec_id"] is not None else None, r["vec_id"] is not None and r["vec_id"] == min(ids)))
    return out


def test_vector_dedup_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows(vector_dedup.near_duplicates(df)) == sorted(plain_dedup(df.collect()))


def test_vector_dedup_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    data = [(i, (centres[i % 6] + 0.14 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(240)] + [(240 + i, centres[0].astype(np.float32).tolist(), 0) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    want = sorted(plain_dedup(df.collect()))
    assert rows(vector_dedup.near_duplicates(df, window=16)) == want
    members = vector_dedup.count_links  # tiles of a large component
    monkeypatch.setattr(vector_dedup, "count_links", lambda m, least: members(m, least, tile=7))
    assert rows(vector_dedup.near_duplicates(df, window=16)) == want


def test_vector_dedup_of_odd_rows(spark):
    df = odd_vectors(spark)
    got, want = rows(vector_dedup.near_duplicates(df)), plain_dedup(df.collect())
    assert [r for r in got if r[0] is not None] == sorted(r for r in want if r[0] is not None)
    assert [r for r in got if r[0] is None] == [(None, 0, None, False)]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def crowded(n, pairs):
    """Vectors around one direction (mean cosine 0.8), some with a partner at cosine 0.935."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((n, 64)) * 0.5 / 8
    v[:, 0] += 1
    v /= np.sqrt((v * v).sum(1))[:, None]
    w = v[rng.permutation(n)[:pairs]]
    side = rng.standard_normal((pairs, 64))
    side -= (side * w).sum(1)[:, None] * w
    side /= np.sqrt((side * side).sum(1))[:, None]
    return np.r_[v, 0.935 * w + np.sqrt(1 - 0.935**2) * side].astype(np.float32)


def links_of(v):
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    return (u @ u.T >= 0.93).sum(1) - 1


def test_no_link_of_a_crowded_label_is_missed(spark, monkeypatch):
    v = crowded(6000, 300)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = np.array([r[1] for r in rows(vector_dedup.near_duplicates(df))])
    want = links_of(v)
    assert want.sum() > 500 and (got == want).all()
    # so many passes are allowed that no label is checked after them
    monkeypatch.setattr(vector_dedup.label_passes, "__defaults__", (10**6,))
    by_passes = np.array([r[1] for r in rows(vector_dedup.near_duplicates(df, exact_rows=0))])
    assert by_passes.sum() >= 0.99 * want.sum()


def test_passes_grow_with_the_label():
    v = np.random.default_rng(2).standard_normal((500, 64))
    need = [vector_dedup.passes_for(v, n, 0.93, 128, 16) for n in (1000, 100_000, 10_000_000)]
    assert need[0] == 16 < need[1] < need[2]
    assert vector_dedup.passes_for(v + 1, 100_000, 0.93, 128, 16) > need[1]


def test_recall_against_brute_force_at_a_tenth(spark):
    """The vectors of sf0.1, each third with a partner at cosine 0.935: whole tiles find every link, the passes nearly every."""
    table = [r for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if plain_usable(r) and r["label"] is not None]
    rng, data = np.random.default_rng(4), [(r["vec_id"], r["embedding"], r["label"]) for r in table]
    for r in table[::3]:
        v, side = vectors.unit(np.array([r["embedding"], rng.standard_normal(len(r["embedding"]))], float))
        side = vectors.unit((side - (side @ v) * v)[None])[0]
        data.append((r["vec_id"] + 10**6, (0.935 * v + np.sqrt(1 - 0.935**2) * side).astype(np.float32).tolist(), r["label"]))
    want = {}
    for label in {r[2] for r in data}:
        own = [r for r in data if r[2] == label]
        want |= dict(zip((r[0] for r in own), links_of(np.array([r[1] for r in own])).tolist()))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    assert sum(want.values()) >= 2 * len(table[::3])
    assert {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(df).collect()} == want
    assert sum(r["n_links"] for r in vector_dedup.near_duplicates(df, exact_rows=0).collect()) >= 0.99 * sum(want.values())


def one_label(n, pairs, mean):
    """``n`` unit vectors of that mean cosine, the first ``pairs`` with a partner at cosine 0.935 at the end."""
    rng = np.random.default_rng(21)
    v = vectors.unit(rng.standard_normal((n, 64))) * np.sqrt(1 - mean)
    v[:, 0] += np.sqrt(mean)
    v, side = vectors.unit(v), rng.standard_normal((pairs, 64))
    w = v[:pairs]
    side = vectors.unit(side - (side * w).sum(1)[:, None] * w)
    return np.r_[v, 0.935 * w + np.sqrt(1 - 0.935**2) * side].astype(np.float32)


def test_recall_in_a_label_beyond_the_exact_check(spark):
    """By passes alone where they settle the label; a crowded one is checked exactly whatever its size."""
    n, pairs = 16_000, 400
    for mean in (0.0, 0.8):
        v = one_label(n, pairs, mean)
        needed = vector_dedup.passes_for(v[::33], len(v), 0.93, vector_dedup.WINDOW, vector_dedup.PASSES)
        assert (needed <= vector_dedup.MOST_PASSES) == (mean == 0)
        df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(4)
        component = {r["vec_id"]: r["component_id"] for r in vector_dedup.near_duplicates(df, exact_rows=0).collect()}
        found = sum(component[i] == component[n + i] for i in range(pairs))
        assert found >= (0.99 * pairs if mean == 0 else pairs)


def test_units_of_the_order_overlap(spark):
    """Links across the ends of units are found: windows do not end at them."""
    v = one_label(900, 200, 0.0)
    df = spark.createDataFrame([(i, 1, 64, x.tolist()) for i, x in enumerate(v)], "node long, grp long, dim int, v array<float>")
    plain = {tuple(r) for r in vector_dedup.candidate_edges(df, passes=2, window=2000).collect()}
    assert {a for a, _ in plain} | {b for _, b in plain}
    cut = {tuple(r) for r in vector_dedup.candidate_edges(df, passes=2, window=64, unit_rows=128).collect()}
    whole = {tuple(r) for r in vector_dedup.candidate_edges(df, passes=2, window=64, unit_rows=10**6).collect()}
    nodes = lambda edges: {x for e in edges for x in e}
    assert nodes(cut) == nodes(whole) and len(nodes(cut)) > 50


def test_every_label_is_checked_exactly(spark, monkeypatch):
    """By default nothing rests on the passes, at no size of a label: here they find nothing and claim to be enough."""
    assert inspect.signature(vector_dedup.near_duplicates).parameters["exact_rows"].default is None
    v = crowded(900, 60)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vector_dedup.label_passes, "__defaults__", (10**6,))
    monkeypatch.setattr(vector_dedup, "candidate_edges", lambda nodes, *_: nodes.selectExpr("node as a", "node as b").limit(0))
    got = np.array([r[1] for r in rows(vector_dedup.near_duplicates(df))])
    assert (got == links_of(v)).all() and got.sum() > 0
