"""Token counts of whole texts by a SentencePiece BPE model.

Texts of up to ``HUGE_CHARS`` characters are encoded whole.  A longer one is
encoded in chunks that overlap, with the offsets of their tokens, and the
chunks are spliced where both have a token boundary that is *proven* stable:
no piece of the vocabulary holds the two characters around it side by side,
so no merge can ever reach across, and what stands on either side cannot
change the other.  When an overlap holds no such boundary it is widened, up
to the whole text, so the counts are those of the whole text in every case.

The proof needs a BPE model whose normaliser changes nothing but the space
sign; other models are encoded whole, and the chunks are not used.

The driver reads the model file and sends its bytes, so executors need no file.

Defined results: a null text is empty: no bytes and no tokens; repeated rows
are counted each; an empty table gives an empty one; columns besides id and text
play no part, whatever their names (the id column may not be named like an
output).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import file_bytes, row_runs

HUGE_CHARS = 1 << 16
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
SPACE = "▁"


class PieceCounter:
    """Counts tokens of texts by a model file's bytes; chunks texts longer than ``huge`` characters."""

    def __init__(self, model: bytes, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.huge, self.chunk, self.overlap = huge, chunk, min(overlap, chunk // 2)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        pieces = [p for p in spec.pieces if p.type == spec.SentencePiece.NORMAL]
        no_symbols = not any(p.type == spec.SentencePiece.USER_DEFINED for p in spec.pieces)
        self.chunkable = plain and no_symbols and norm.add_dummy_prefix and spec.trainer_spec.byte_fallback and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
        self.joined = {p.piece[i : i + 2] for p in pieces for i in range(len(p.piece) - 1)}
        size = self.model.get_piece_size()
        byte = [int(self.model.id_to_piece(i)[3:5], 16) if self.model.is_byte(i) else -1 for i in range(size)]
        self.continued = np.array([0x80 <= b < 0xC0 for b in byte])
        self.chars = np.array([int(not 0x80 <= b < 0xC0) if b >= 0 else len(self.model.id_to_piece(i)) for i, b in enumerate(byte)], dtype=np.int64)
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge of any text can reach across ``at``."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def boundaries(self, text: str, start: int, stop: int) -> list[int]:
        """Where the tokens of ``text[start:stop]`` begin, as offsets into the text."""
        ids = np.array(self.model.encode(text[start:stop]), dtype=np.int64)
        upto = np.cumsum(self.chars[ids]) - self.chars[ids] - self.continued[ids]
        return (start - 1 + upto).tolist()  # the model puts a space sign before the first character

    def count_huge(self, text: str) -> int:
        """The count of a long text, spliced from overlapping chunks."""
        total, start, done = 0, 0, 0  # tokens before `done` are counted
        stop = min(len(text), self.chunk)
        begins = self.boundaries(text, start, stop)
        while stop < len(text):
            width = self.overlap
            while True:
                start = max(done, stop - width)
                new_stop = min(len(text), start + self.chunk + width)
                new = self.boundaries(text, start, new_stop)
                own = {b for b in begins if start < b < stop}
                common = [b for b in new if b in own and self.stable(text, b)]
                if common:
                    splice = common[len(common) // 2]
                    total += sum(b < splice for b in begins)
                    done, stop = splice, new_stop
                    begins = [b for b in new if b >= splice]
                    break
                self.widened += 1
                if start <= done:
                    # No boundary in all that is left of this chunk: encode on from the last one.
                    stop = min(len(text), stop + max(self.chunk, stop - done))
                    lead = self._lead(text, done)
                    begins = [b for b in self.boundaries(text, lead, stop) if b >= done or not done]
                    break
                width *= 2
        return total + len(begins)

    def _lead(self, text: str, done: int) -> int:
        """Where to begin encoding so that the tokens from ``done`` on are those of the whole text."""
        return max(0, done - 1)

    def count(self, texts: list[str]) -> list[int]:
        """The count of each text."""
        long = [k for k, t in enumerate(texts) if len(t) > self.huge] if self.chunkable else []
        if not long:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out = [len(x) for x in self.model.encode(["" if len(t) > self.huge else t for t in texts], num_threads=1)]
        for k in long:
            out[k] = self.count_huge(texts[k])
        return out


_LOADED: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_bytes, n_tokens, over_limit`` of every whole text."""
    model, digest = file_bytes(path)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _LOADED:
            _LOADED[digest] = PieceCounter(sent.value)
        counter = _LOADED[digest]
        for batch in row_runs(batches, 200):
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
