from loomfed.llm import ngram_join
from loomfed.llm.components import connected_components

from .helpers import brute_components, documents, edited, prose, shingles


def _corpus():
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "É a b"), (8, "é a b"), (9, "a b c d e"), (10, "a  b\nc\td e")]
    n = 20
    for family in range(12):
        base = prose(family, 60 + 7 * family)
        rows.append((n, base))
        for k in range(6):
            rows.append((n + 1 + k, edited(base, 100 * family + k, 0.01 * (k + 1))))
        rows.append((n + 7, base))
        n += 8
    passage = prose(999, 40)
    for k in range(40):  # a common passage in texts that do not link
        rows.append((n + k, prose(5000 + k, 45) + " " + passage + " " + prose(7000 + k, 20)))
    n += 40
    hot = prose(31, 120)
    for k in range(60):  # a large group of near copies
        rows.append((n + k, hot + f" end{k} tail{k}"))
    return rows


def _got(spark, rows, **options):
    out = ngram_join.near_duplicates(documents(spark, rows), **options).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def test_equals_all_pairs(spark):
    rows = _corpus()
    got = _got(spark, rows)
    want = brute_components(rows)
    assert {d: c for d, (_, c) in got.items()} == want
    assert all(got[r[0]][0] == len(shingles(r[1])) for r in rows)


def test_order_of_shingles_changes_nothing(spark, monkeypatch):
    rows = _corpus()[:70]
    monkeypatch.setattr(ngram_join, "HEAVY_LOCAL", 10**9)
    job = ngram_join.NgramJoin(documents(spark, rows), heavy_terms=1)
    assert {r["doc_id"]: r["component_id"] for r in job.components().collect()} == brute_components(rows)
    job.close()


def test_hot_lists_and_hubs_change_nothing(spark, monkeypatch):
    """Common shingles are dealt by salt, and hubs' sets go in copies."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 64)
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 4)
    monkeypatch.setattr(ngram_join, "HEAVY_LOCAL", 2)
    rows = _corpus()
    assert {d: c for d, (_, c) in _got(spark, rows).items()} == brute_components(rows)


def test_ten_thousand_copies_and_a_common_shingle(spark):
    base = prose(8, 60, 10**6)
    line = prose(9, 5, 10**6)
    rows = [(10_000 + k, base) for k in range(10_000)] + [(k, prose(100 + k, 40, 10**6) + " " + line + " " + prose(900 + k, 8, 10**6)) for k in range(150)]
    rows += [(500 + k, edited(base, k, 0.02)) for k in range(20)]
    got = {d: c for d, (_, c) in _got(spark, rows).items()}
    few = [r for r in rows if r[0] <= 10_000]
    want = brute_components(few)
    assert {d: got[d] for d, _ in few} == want
    assert {got[10_000 + k] for k in range(10_000)} == {want[10_000]}


def test_same_prefix_but_other_size(spark):
    base = prose(3, 100, 10**6)
    words = base.split(" ")
    rows = [(k, " ".join(words[: 100 - k])) for k in range(12)]
    assert {d: c for d, (_, c) in _got(spark, rows).items()} == brute_components(rows)


def test_nulls_repeats_empty_and_clashes(spark):
    text = prose(1, 30)
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (9, text, None), (7, None, 1)], "doc_id long, text string, n int")
    df = df.withColumnRenamed("n", "id").selectExpr("*", "id AS token", "id AS a")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(-1, 26, None), (4, 26, 4), (4, 26, 4), (7, 0, 7), (9, 26, 4)]
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [4, 4, 7]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = prose(1, 40), prose(2, 40)
    rows = [(3, a), (5, a), (5, b), (8, b)]
    out = ngram_join.near_duplicates(documents(spark, rows)).collect()
    assert {r["component_id"] for r in out} == {3}


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (400, 300), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(201)} | {300: 300, 400: 300, 500: 300}


def test_components_of_random_graphs_and_hubs(spark, monkeypatch):
    import random

    from loomfed.llm import components

    monkeypatch.setattr(components, "HOT_LEAST", 3)
    monkeypatch.setattr(components, "CONTRACT_ROWS", 7)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(900, k) for k in range(500, 560)] + [(k, 1000 + k) for k in range(500, 560, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9), "a", "b").collect()}
    assert all(got[n] == find(n) for n in got) and set(got) == {n for a, b in edges if a != b for n in (a, b)}
