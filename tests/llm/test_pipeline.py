"""The pipeline against a brute-force version, stage by stage."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomfed.llm import poisson_mix
from loomfed.llm.byte_bpe import load_ranks
from loomfed.llm.queries import oracle_sql, queries

from .helpers import DOCS, brute_components, edited, prose

BAD = ("Idiot", "idiot!", "IDIOT,")  # one word: the fixture has a few dozen positives


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(420):
        text = prose(k, rng.randrange(20, 120), 3000)
        if k % 7 == 0:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), BAD[k // 7 % 3])
            text = " ".join(words)
        rows.append((k, text, "en", f"src{k % 3}"))
        if k % 2 == 0:
            labels.append((k, 1, int(k % 7 == 0)))
    rows += [(1000 + k, rows[k + 1][1].replace(" ", "  "), "en", "src0") for k in range(0, 60, 3)]  # exact copies
    rows += [(2000 + k, edited(rows[k + 1][1], k, 0.01), "en", "hot") for k in range(0, 60, 2)]  # near copies
    rows += [(3000, None, None, None), (3001, "", "en", None), (3002, " ", "en", "src1"), (3003, "é" * 3000, "fr", "src2")]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return rows, str(where)


def _is_bad(text):
    return bool(re.search("idiot", text or "", re.I))


def test_stages_equal_brute_force(spark, world):
    rows, sf_dir = world
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mix", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), DOCS)
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    clean = {r[0]: r[1] for r in rows if not _is_bad(r[1])}
    # the classifier is learnt: nearly all toxic ones go, and nearly all clean ones stay
    assert len(set(clean) - set(kept["toxicity"])) <= 3 and len(set(kept["toxicity"]) - set(clean)) <= 3
    texts = {r[0]: r[1] for r in rows if r[0] in kept["toxicity"]}
    first = {}
    for d, t in sorted(texts.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    assert set(kept["exact_dedup"]) == set(first.values())
    component = brute_components([(d, texts[d]) for d in kept["exact_dedup"]])
    assert set(kept["ngram_join"]) == set(component.values())
    assert all(n == 1 for n in kept["ngram_join"].values())
    assert set(kept["mix"]) <= set(kept["ngram_join"])
    source = {r[0]: r[3] for r in rows}
    sizes = Counter(source[d] for d in kept["ngram_join"])
    weights = {s: n**0.5 for s, n in sizes.items()}
    for d in kept["ngram_join"]:
        rate = weights[source[d]] / sum(weights.values()) * sum(sizes.values()) / sizes[source[d]]
        u = int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:13], 16) / 2**52
        assert kept["mix"][d] == sum(p <= u for p in poisson_mix.poisson_cdf(rate))


def test_run_gives_tokens_of_what_is_kept(spark, world):
    rows, sf_dir = world
    texts = {r[0]: r[1] or "" for r in rows}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) > 200
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_tables_and_clashing_columns(spark, world, tmp_path):
    rows, sf_dir = world
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    names = ["_id", "_sha", "_doc", "_text", "_toxic", "id", "token", "component_id", "_source", "_copy", "ids", "n_tokens", "toxic", "score"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    wide.limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    wide.filter("doc_id % 3 = 0 or doc_id is null").write.parquet(f"{tmp_path}/b/documents.parquet")
    for part in "ab":
        labels.limit(0 if part == "a" else 10_000).write.parquet(f"{tmp_path}/{part}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"{tmp_path}/b")
        assert docs.columns == wide.columns
    out = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want.project(quoted).fetchall()))
