import brute
import numpy as np


def test_near_vectors(spark):
    from landtally.llm.vectors import near_vectors
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((30, 16))
    rows = []
    for k in range(600):
        x = centre[k % 30] + rng.standard_normal(16) * (0.05 + 0.25 * (k % 3))
        rows.append((k, x.tolist(), k % 30 % 3))
    rows += [(1000 + k, rows[5][1], 2) for k in range(50)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[5][1], None),
             (2005, [float("inf")] + [0.0] * 15, 1), (2006, [], 1), (2007, (np.array(rows[5][1]) * 1e200).tolist(), 2)]
    table = spark.createDataFrame([(i, x, y, "n") for i, x, y in rows], "vec_id long, embedding array<double>, label int, node string")
    good = [(i, np.array(x) / np.abs(x).max(), y) for i, x, y in rows if i < 2000 or i == 2007]
    links = []
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2]:
                u, v = good[a][1], good[b][1]
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    links.append((good[b][0], good[a][0]))
    where = brute.components([i for i, _, _ in rows], links)
    counts = {i: 0 for i, _, _ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()}
    assert got == {i: (counts[i], where[i], where[i] == i) for i in counts}
    assert near_vectors(table.limit(0)).count() == 0


def test_components(spark):
    from landtally.llm.graph import components
    rng = np.random.default_rng(4)
    names = rng.permutation(1 << 20)[:400]
    links = [(int(names[k]), int(names[k + 1])) for k in range(0, 200)] + [(int(names[300]), int(names[k])) for k in range(301, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(5, 5)], "a long, b long")).collect()}
    want = brute.components({x for e in links for x in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors_between_tight_clusters(spark):
    """Every vector has more than 40 neighbours in its own cluster that are nearer than any of the other cluster."""
    from landtally.llm.vectors import near_vectors
    rng = np.random.default_rng(6)
    near = np.zeros((2, 64))
    near[:, 0], near[1, 1] = 1.0, np.tan(np.arccos(0.945))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    x = np.repeat(near, 150, axis=0) + rng.standard_normal((300, 64)) * 0.001
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert got == {k: (links[k], 0) for k in range(300)} and links.min() > 200


def test_near_vectors_in_several_blocks(spark, monkeypatch):
    """Rare pairs exactly at hand among many vectors without a link, over many blocks."""
    from landtally.llm import vectors as V
    monkeypatch.setattr(V, "BLOCK", 100)
    monkeypatch.setattr(V, "STRIPE", 30)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 64))
    for k in range(40):
        x[1499 - k] = x[k] / np.linalg.norm(x[k]) * 8 + rng.standard_normal(64) * 0.38
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()
    where = brute.components(range(1500), close)
    counts = np.bincount(np.array(close).ravel(), minlength=1500)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(table).collect()}
    assert len(close) > 10 and got == {k: (counts[k], where[k]) for k in range(1500)}
