import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from loomfed.llm import byte_bpe, token_counts
from loomfed.llm.byte_bpe import ByteBPE, MergeTable, PieceCache, file_bytes, load_ranks, replay_merges
from loomfed.llm.token_counts import PieceCounter

from .helpers import documents, prose

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
MODEL = file_bytes(PIECES)[0]


def _texts():
    rng = random.Random(4)
    alphabet = "ab aé\n\t 1'’s한국aaa<|endoftext|>   \x00"
    out = ["", " ", "a" * 5000, " " * 3000, "\n\n a" * 500, prose(1, 3000), "<s>x</s> <0x41> ▁▁y", "it's we'll  I'd", "𝒳🙂" * 50]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(library):
    coder, texts = ByteBPE(load_ranks(RANKS), P.PATTERN, known=500), _texts()
    got = coder.encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(x).decode() for x in got] == texts


def test_ranks_that_fall_are_replayed_in_turn():
    """Merges whose result has a lower rank than its parts, against merging piece by piece."""
    rng = random.Random(2)
    base = [bytes([b]) for b in range(256)]
    for _ in range(30):
        tokens = list({bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(25)})
        rng.shuffle(tokens)
        order = tokens[:12] + base + tokens[12:]
        ranks = {t: k for k, t in enumerate(order)}
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 14))) for _ in range(60)]

        def alone(piece, ranks=ranks):
            if piece in ranks:
                return [ranks[piece]]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not found:
                    return [ranks[p] for p in parts]
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        assert replay_merges(pieces, MergeTable(ranks)) == [alone(p) for p in pieces]


def test_long_texts_are_read_in_parts(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_CHARS", 64)
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 100)
    coder, texts = ByteBPE(load_ranks(RANKS), P.PATTERN), _texts()
    for text, (n, ids, back) in zip(texts, coder.digests(texts), strict=True):
        want = library.encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert back == hashlib.sha256(text.encode()).hexdigest()


def test_the_cache_is_bounded():
    cache = PieceCache(10)
    for k in range(100):
        for p in cache.missing({"common", f"p{k}"}):
            cache.young[p] = k
    assert len(cache.young) + len(cache.old) <= 14 and cache.young["common"] == 0


def test_bpe_tables(spark, library):
    rows = [(k, t) for k, t in enumerate(_texts()[:40])] + [(900, None), (None, "x y"), (3, "again")]
    df = documents(spark, rows).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = byte_bpe.encode_digests(df, RANKS, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), len(library.encode_ordinary(t or ""))) for d, t in rows)
    ids = byte_bpe.encode(df.drop("ids"), RANKS, P.PATTERN)
    back = {(r["doc_id"], bytes(r["bytes"]).decode()) for r in byte_bpe.decode(ids, RANKS, P.PATTERN).collect()}
    assert back == {(d, t or "") for d, t in rows}
    assert byte_bpe.encode_digests(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_the_worker_gets_its_collector_back(spark):
    import gc

    df = documents(spark, [(k, "a b c") for k in range(20)]).repartition(2)
    byte_bpe.encode_digests(df, RANKS, P.PATTERN).count()
    states = df.select("doc_id").mapInPandas(lambda parts: (p.assign(doc_id=int(gc.isenabled())) for p in parts), "doc_id long")
    assert {r[0] for r in states.collect()} == {1}


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(10, 8, 2), (40, 32, 4), (200, 100, 10), (1 << 16, 1 << 15, 1 << 9)])
def test_spliced_counts_equal_whole_counts(huge, chunk, overlap):
    counter, texts = PieceCounter(MODEL, huge, chunk, overlap), [*_texts(), prose(3, 20_000)]
    assert counter.chunkable
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert counter.count(texts) == [len(x) for x in whole.encode(texts)]


def test_overlaps_are_widened_without_a_boundary():
    counter = PieceCounter(MODEL, 100, 64, 8)
    text = "a" * 1000 + " b" + "é" * 500
    assert counter.count([text]) == [len(counter.model.encode(text))] and counter.widened > 0


def test_count_table(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é"), (4, "word " * 5000)]
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = documents(spark, rows).selectExpr("*", "1 AS n_tokens")
    got = sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(df, PIECES).collect())
    want = sorted((str(d), len((t or "").encode()), n := len(whole.encode(t or "")), n > 4096) for d, t in rows)
    assert got == want
    assert token_counts.token_counts(df.limit(0), PIECES).count() == 0
