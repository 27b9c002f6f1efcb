"""Rounds of products and paths never broadcast a side."""

from lumengraph.operators import distances, spectral


def test_rounds_join_by_merge(spark, monkeypatch):
    pairs = [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.95), (2, 3, 0.99)]
    nodes = spark.createDataFrame([(1, n) for n in range(4)], "image_id int, node int")
    edges = spark.createDataFrame([(1, *p) for p in pairs], "image_id int, src int, dst int, weight double")
    arcs = spark.createDataFrame([(1, u, v, 1.0) for s, d, _ in pairs for u, v in ((s, d), (d, s))], "image_id int, u int, v int, cost double")
    seen = []
    for module in (distances, spectral):
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda df, cut=cut: (seen.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    paths = distances.shortest_paths(nodes, arcs)
    assert {(r.s, r.t): r.d for r in paths.collect()}[0, 3] == 2.0
    components = nodes.selectExpr("image_id", "node", "0 AS component")
    first = len(seen)
    assert spectral.extreme_eigenvalues(nodes, edges, components, rounds=3).first().spectral_gap > 0
    rounds = seen[1:first] + [p for p in seen[first + 2 :]]
    assert any("SortMergeJoin" in p for p in seen[:first]) and any("SortMergeJoin" in p for p in seen[first:])
    assert not any("BroadcastHashJoin" in p for p in rounds)
