"""PageRank against plain power iteration with the operator's defaults."""

from skarn.queries import QUERIES, structure

D = "/root/testdata/sf0.001"


def brute(edges, seeds, steps=30, tolerance=1e-6):
    total, nodes = {}, {x for a, b, _ in edges for x in (a, b)}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    own = {x: (x in seeds) / len(seeds & nodes) for x in nodes}
    rank = dict(own)
    for _ in range(steps):
        lost = sum(rank[x] for x in nodes if x not in total)
        new = {x: (0.15 + 0.85 * lost) * own[x] for x in nodes}
        for a, b, w in edges:
            new[b] += 0.85 * rank[a] * w / total[a]
        done = sum(abs(new[x] - rank[x]) for x in nodes) < tolerance
        rank = new
        if done:
            break
    return rank


def test_the_query_runs_to_the_operators_end(spark):
    edges, _ = structure._rank_graph(spark, D)
    want = brute([tuple(r) for r in edges.select("src", "dst", "weight").collect()], {"c:1", "n:2"})
    got = {r["node"]: r["rank"] for r in QUERIES["pagerank_converged"](spark, D).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
