"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A run of documents is cut by the tokenizer's pattern.  The distinct pieces of
the run that are not known yet are laid out in one flat array of tokens, with
an inverted index from the rank of a mergeable token pair to the positions
where it stands.  Ranks are replayed in ascending order; a merge touches its
own position and its two neighbours and nothing else.  Merges never cross a
piece, so the replay of a run gives each piece the ids that the replay of the
whole corpus would, and a run is as large as memory is meant to be
(``RUN_CHARS``), however large the corpus is.

A worker keeps the encodings of about ``KNOWN_PIECES`` pieces, those seen last;
that bounds memory and changes no result.  Very long texts
are read match by match.  The driver reads the rank file and sends its bytes, so
executors need no file.

Defined results: a null text is empty and has no ids; repeated rows are
encoded each; an empty table gives an empty one; columns besides id and text
play no part, whatever their names (the id column may not be named like an
output).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import give_back

RUN_CHARS = 1 << 18
KNOWN_PIECES = 300_000
LONG_CHARS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    return parse_ranks(file_bytes(path)[0])


def parse_ranks(data: bytes) -> dict[bytes, int]:
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def file_bytes(path: str) -> tuple[bytes, str]:
    """What a tokenizer file holds, a megabyte or two, and its digest."""
    with open(path, "rb") as data:
        whole = data.read()
    return whole, hashlib.sha256(whole).hexdigest()


class MergeTable:
    """The rank file as ids: which pair of ids merges into which id.

    An id is the rank of its token.  ``pairs`` has every split of every token
    into two tokens, under ``left * PAIR + right``.
    """

    PAIR = 1 << 20
    GAP = (1 << 20) - 1  # stands between two pieces; no pair holds it

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.PAIR + right] = rank
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)


def replay_merges(pieces: list[bytes], table: MergeTable) -> list[list[int]]:
    """Ids of each piece, by replaying the merges over all pieces at once."""
    out: list[list[int]] = [[] for _ in pieces]
    open_pieces = []
    for k, piece in enumerate(pieces):
        whole = table.ranks.get(piece)
        if whole is not None:
            out[k] = [whole]
        elif piece:
            open_pieces.append(k)
    if not open_pieces:
        return out
    # One flat array: each piece's bytes with a gap before and after it.
    lengths = np.array([len(pieces[k]) for k in open_pieces], dtype=np.int64)
    firsts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    flat = np.full(int(firsts[-1]), table.GAP, dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[0] = False
    inside[firsts[1:] - 1] = False
    flat[inside] = table.byte_ids[np.frombuffer(b"".join(pieces[k] for k in open_pieces), dtype=np.uint8)]
    get = table.pairs.get
    unit, gap = table.PAIR, table.GAP
    keys = flat[:-1] * unit + flat[1:]
    kinds, which = np.unique(keys, return_inverse=True)
    ranked = np.array([get(int(x), -1) for x in kinds], dtype=np.int64)[which]
    ids: list[int] = flat.tolist()
    pending: list[int] = [*ranked.tolist(), -1]  # the rank of the pair that begins here
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    # The inverted index: rank of a pair -> positions where it stands.
    order = np.argsort(ranked, kind="stable")
    order = order[np.searchsorted(ranked[order], 0) :]
    values, cuts = np.unique(ranked[order], return_index=True)
    index = {int(v): part.tolist() for v, part in zip(values, np.split(order, cuts[1:]), strict=True)} if len(order) else {}
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for at, i in enumerate(places):
            if pending[i] != rank:
                continue
            j = after[i]
            k = after[j]
            ids[i] = rank
            ids[j] = -1
            pending[j] = -1
            after[i] = k
            before[k] = i
            least = rank + 1
            new = get(rank * unit + ids[k], -1)
            pending[i] = new
            if new >= 0:
                if new in index:
                    index[new].append(i)
                else:
                    index[new] = [i]
                    heapq.heappush(queue, new)
                if new < least:
                    least = new
            h = before[i]
            left = ids[h]
            if left != gap:
                new = get(left * unit + rank, -1)
                pending[h] = new
                if new >= 0:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    if new < least:
                        least = new
            if least <= rank:  # a pair of this or a lower rank has come up: it goes before the rest
                rest = places[at + 1 :]
                if rest:
                    if rank in index:
                        index[rank].extend(rest)
                    else:
                        index[rank] = rest
                        heapq.heappush(queue, rank)
                break
    merged = np.array(ids, dtype=np.int64)
    alive = (merged >= 0) & (merged != gap)
    upto = np.zeros(len(merged) + 1, dtype=np.int64)
    np.cumsum(alive, out=upto[1:])
    kept = merged[alive].tolist()
    cuts_at = upto[firsts].tolist()
    for n, k in enumerate(open_pieces):
        out[k] = kept[cuts_at[n] : cuts_at[n + 1]]
    return out


class PieceCache:
    """What is known of pieces, in two generations.

    When the young generation is full it becomes the old one, and the old one
    goes; a piece of the old one that is seen again is young again.  So common
    pieces stay, and the number of pieces is bounded.
    """

    def __init__(self, known: int) -> None:
        self.half = max(1, known // 2)
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces that are not known; the others are young from now on."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        absent = pieces - self.young.keys()
        known = absent & self.old.keys()
        for p in known:
            self.young[p] = self.old[p]
        return list(absent - known)


class ByteBPE:
    """Encodes and decodes texts by a rank file and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN_PIECES) -> None:
        self.merges = MergeTable(ranks)
        self.tokens = {rank: token for token, rank in self.merges.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.tokens}
        self.find = regex.compile(pattern)
        self.ids_of = PieceCache(known)
        self.digest_of = PieceCache(known)

    def _new(self, cache: PieceCache, run: list[tuple[int, list[str], bool]]) -> Iterator[tuple[str, list[int]]]:
        """The pieces of the run that the cache lacks, and their ids."""
        seen: set[str] = set()
        for _, pieces, _ in run:
            seen.update(pieces)
        new = cache.missing(seen)
        return zip(new, replay_merges([p.encode() for p in new], self.merges), strict=True)

    def runs(self, texts: list[str]) -> Iterator[list[tuple[int, list[str], bool]]]:
        """Runs of (text number, pieces, whether the text ends here)."""
        run, size = [], 0
        for k, text in enumerate(texts):
            if len(text) > LONG_CHARS:
                matches = self.find.finditer(text)
                while part := [m[0] for m in islice(matches, LONG_CHARS // 4)]:
                    yield [*run, (k, part, False)]
                    run, size = [], 0
                run = [(k, [], True)]
                continue
            run.append((k, self.find.findall(text), True))
            size += len(text)
            if size > RUN_CHARS:
                yield run
                run, size = [], 0
        if run:
            yield run

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        out: list[list[int]] = [[] for _ in texts]
        for run in self.runs(texts):
            for piece, ids in self._new(self.ids_of, run):
                self.ids_of.young[piece] = ids
            for k, pieces, _ in run:
                for p in pieces:
                    out[k] += self.ids_of.young[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of a list of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded bytes, text by text."""
        count, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        digits = self.digits
        for run in self.runs(texts):
            for piece, ids in self._new(self.digest_of, run):
                self.digest_of.young[piece] = (len(ids), " ".join([digits[i] for i in ids]), self.decode(ids))
            table = self.digest_of.young
            for _, pieces, done in run:
                if pieces:
                    numbers, texts_of_ids, back = zip(*map(table.__getitem__, pieces), strict=True)
                    ids_sha.update(((" " if count else "") + " ".join(texts_of_ids)).encode())
                    bytes_sha.update(b"".join(back))
                    count += sum(numbers)
                if done:
                    yield count, ids_sha.hexdigest(), bytes_sha.hexdigest()
                    count, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()


_LOADED: dict[tuple[str, str], ByteBPE] = {}
Work = Callable[[ByteBPE, pa.RecordBatch], pa.RecordBatch]


def _coded(narrow: DataFrame, path: str, pattern: str, rows: int, work: Work, schema: str) -> DataFrame:
    """``work`` on every ``rows`` rows, with the coder that a worker has for the rank file."""
    data, digest = file_bytes(path)
    sent = narrow.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tables hold no cycles, and walking them costs more than all else; the worker gets its collector back
        collected = gc.isenabled()
        gc.disable()
        try:
            if (digest, pattern) not in _LOADED:
                _LOADED[digest, pattern] = ByteBPE(parse_ranks(sent.value), pattern)
            for batch in row_runs(batches, rows):
                yield work(_LOADED[digest, pattern], batch)
        finally:
            if collected:
                gc.enable()
            give_back()

    return narrow.mapInArrow(run, schema)


def _texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def row_runs(batches: Iterable[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _narrow(df: DataFrame, id_col: str, other: str) -> tuple[DataFrame, str]:
    """The id and another column, and the id's part of a schema."""
    narrow = df.select(F.col(f"`{id_col}`"), F.col(f"`{other}`"))
    return narrow, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: the id column and ``ids array<int>``."""

    def work(coder: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder.encode(_texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    narrow, own = _narrow(docs, id_col, text_col)
    return _coded(narrow, path, pattern, 500, work, f"{own}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every list of ids: the id column and ``bytes binary``; a null list is empty."""

    def work(coder: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    narrow, own = _narrow(encoded, id_col, ids_col)
    return _coded(narrow, path, pattern, 500, work, f"{own}, bytes binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded again."""

    def work(coder: ByteBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(coder.digests(_texts(batch.column(1))))
        n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow, own = _narrow(docs, id_col, text_col)
    return _coded(narrow, path, pattern, 2_000, work, f"{own}, n_tokens long, ids_sha256 string, decoded_sha256 string")
