import hashlib
import re
from collections import defaultdict

from loomfed.llm import exact_dedup

from .helpers import documents, prose


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _rows():
    rows = [(k, prose(k % 7, 20)) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\n\t "), (104, "a b"), (105, "a b"), (106, "a\x0bb"), (107, "A b"), (50, "x" * 200_000), (51, "x" * 200_000)]
    return rows


def test_against_brute_force(spark):
    rows = _rows()
    groups = defaultdict(list)
    for d, t in rows:
        groups[_norm(t)].append(d)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        own = groups[_norm(t)]
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), d == min(own))
        assert r["text_sha256"] == hashlib.sha256(_norm(t).encode()).hexdigest()
    kept = exact_dedup.drop_copies(documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_collisions_do_not_merge(spark, monkeypatch):
    """With a digest that always collides, full texts still decide."""
    plain = exact_dedup._digested

    def colliding(*args):
        from pyspark.sql import functions as F

        return plain(*args).withColumn("_sha", F.lit("same"))

    monkeypatch.setattr(exact_dedup, "_digested", colliding)
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_repeats_nulls_empty_clashes(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 1, 2), (None, "a", 3, 4), (None, "z", 5, 6), (2, "q", None, None)], "doc_id long, text string, _sha int, keep_id int")
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [("1", "1", 3, False), ("1", "1", 3, True), ("2", "2", 1, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_hot_groups_and_clashing_names(spark, monkeypatch):
    """Hot and cold groups give the same rows; columns may have any names."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    rows = [(k, "hot  text" if k % 3 else f"text {k % 30}") for k in range(120)]
    names = ["_lost_id", "_lost_sha", "_sha", "_id", "_keep", "_first", "_doc", "_file", "a.b"]
    docs = documents(spark, rows).withColumns({f"{n}": F.lit(n) for n in names})
    groups = defaultdict(list)
    for d, t in rows:
        groups[_norm(t)].append(d)
    for r in exact_dedup.exact_dedup(docs).collect():
        own = groups[_norm(rows[r["doc_id"]][1])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_repeated_ids_with_unlike_columns(spark):
    """Of rows with one id and text one stays, the same each time, whatever the order of the rows."""
    rows = [(1, "a", k, "x") for k in range(6)] + [(None, "n", k, "y") for k in range(6)] + [(1, "b", 0, "z"), (2, "b", 1, "z")]
    schema = "doc_id long, text string, extra int, source string"
    found = [sorted(map(str, exact_dedup.drop_copies(spark.createDataFrame(order, schema)).collect())) for order in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 3
    flags = exact_dedup.exact_dedup(spark.createDataFrame(rows, schema)).collect()
    assert sum(r["kept"] for r in flags) == 3 and {r["group_size"] for r in flags} == {6, 2}
