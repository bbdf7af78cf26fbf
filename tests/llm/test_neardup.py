import random

import numpy as np
import pytest

from quillroute.llm import neardup as D


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed, n_groups=12):
    r = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([3, 6, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = f"x{r.randint(0, 99)}"
            rows.append((len(rows), " ".join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, docs_of, seed):
    rows = near_copies(seed)
    out = D.near_duplicates(docs_of(rows, extra=True), D.NearDupParams(block=4)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows)


def test_edges(spark, docs_of):
    rows = [(5, None), (6, ""), (7, "  \n "), (8, "A b"), (3, "a B"), (9, "a b c d e"), (9, "a b c d e"), (None, "A B C D E"), (10, "long word " * 30_000), (11, "long word " * 29_000), (1, None)]
    out = D.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows)
    kept = D.drop_near_duplicates(docs_of(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["5", "6", "7", "3", "9", "10", "1"])
    assert kept.columns == docs_of(rows).columns
    assert D.near_duplicates(docs_of([])).count() == 0


def test_overlaps_both_ways():
    r = np.random.default_rng(0)
    x = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    y = [np.unique(r.integers(40, 5000, 30).astype(np.uint64)) for _ in range(7)]
    for a, b in ((x, x), (x, y), (y, y)):
        assert D.overlaps(a, b).tolist() == [[len(np.intersect1d(s, t)) for t in b] for s in a]


def test_neighbours_share_the_longest_prefixes():
    """A region's runs by size are connected whole, and by neighbours in the sorted order."""
    p = D.NearDupParams()
    r = np.random.default_rng(3)
    n = np.concatenate((r.integers(10, 13, 40), r.integers(40, 50, 30))).astype(np.uint32)
    deep = r.integers(0, 5, 70).astype(np.uint64)
    a = {"key": np.zeros(70, np.uint64), "row": r.permutation(70), "n": n, "deep": deep}
    u, v = D.neighbours(a, p)
    of = dict(zip(a["row"].tolist(), zip(n.tolist(), deep.tolist())))
    assert len(u) == 68 and all((of[i][0] < 20) == (of[j][0] < 20) for i, j in zip(u, v))
    # each run holds at most five different prefixes, so all but four of its edges are within one
    assert sum(of[i][1] != of[j][1] for i, j in zip(u.tolist(), v.tolist())) <= 8


def test_order_goes_on_through_further_columns():
    p = D.NearDupParams(trees=2, depth=2)
    sig = np.arange(8, dtype=np.uint32).reshape(2, 4)
    assert D.order_keys(sig, 0, p).tolist() == [(2 << 32) | 3, (6 << 32) | 7]
    assert D.order_keys(sig, 1, p).tolist() == [1, (4 << 32) | 5]


def test_no_link_is_lost_in_large_regions(spark, docs_of):
    """Pairs just above 0.75, in regions that are all above the limit."""
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = [f"g{i}w{j}" for j in range(90)]
        for k in range(2):
            t = list(base)
            for j in r.sample(range(2), 1):
                t[20 + 50 * j] = f"x{i}.{k}"
            rows.append((len(rows), " ".join(t)))
    out = D.near_duplicates(docs_of(rows).coalesce(2), D.NearDupParams(region_limit=1, heavy_share=1)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows)
    rows = near_copies(7)
    out = D.near_duplicates(docs_of(rows).coalesce(3), D.NearDupParams(region_limit=2, heavy_share=1)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows)


def test_parts_of_a_large_region_overlap(spark):
    """Every two sets of one region whose sizes allow a link are connected, over all parts."""
    r = random.Random(2)
    p = D.NearDupParams(region_limit=3, heavy_share=1, trees=1)
    size = [int(2 ** (r.random() * 9)) + 1 for _ in range(90)]
    nodes = spark.createDataFrame([(i, n, b"\1" * 16) for i, n in enumerate(size)], "row long, n long, signature binary").repartition(3)
    edges = D.candidate_edges(nodes, len(size), p).collect()
    parent = list(range(len(size)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for e in edges:
        parent[find(e["src"])] = find(e["dst"])
    assert all(find(i) == find(j) for i in range(len(size)) for j in range(i) if 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]))
    assert len(edges) < 4 * len(size)


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    """Jobs deal the rows by the executors alive when they are planned; the numbers stay."""
    from quillroute.llm.common import number_rows

    path = str(tmp_path / "docs")
    spark.range(0, 4000, 1, 5).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text").write.option("parquet.block.size", 20_000).parquet(path)
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    seen = []
    try:
        for values in (("2", "128m", "4m"), ("16", "16k", "1k")):
            for n, v in zip(names, values, strict=True):
                spark.conf.set(n, v)
            rows = number_rows(spark.read.parquet(path).select("doc_id", "text"), "row")
            seen.append((rows.rdd.getNumPartitions(), {r["doc_id"]: r["row"] for r in rows.collect()}))
    finally:
        for n in names:
            spark.conf.unset(n)
    (few, a), (many, b) = seen
    assert many > few and a == b and len(set(a.values())) == 4000
    made = number_rows(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), "row")
    assert len({r["row"] for r in made.collect()}) == 2
    assert number_rows(spark.read.parquet(path).filter("doc_id < 0"), "row").collect() == []
