"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: between a character that is no
white space and an ASCII white-space character. Counts of the pieces therefore add up to the count of
the whole text. Distinct pieces of a batch are encoded once, in calls balanced by bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, map_arrow

#: White space and what follows it up to the next ASCII white space. Other white space never starts a
#: piece, as tokenizers differ on it; a run at the end is a piece of its own.
PIECE = re.compile(r"\s*\S+(?:[^\S \t\n\r\f\v]\s*\S*)*|\s+")
#: Inside one very long piece: changes of character class at which a byte-level pre-tokenizer cuts too.
INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{}~])|(?<=[一-鿿])(?=[、。！，：；？])")
LONG_PIECE = 16_384
#: UTF-8 bytes of the texts of a call; one longer piece is a call of its own.
CALL_BYTES = 262_144
MEMO = 1 << 18


def pieces(text: str, long_piece: int = LONG_PIECE) -> list[str]:
    """Parts of ``text`` at whose borders the pre-tokenizer cuts in any case; joined they are ``text``."""
    out = PIECE.findall(text)
    if len(text) <= long_piece or max(map(len, out), default=0) <= long_piece:
        return out
    cut: list[str] = []
    for piece in out:
        start = 0
        if len(piece) > long_piece:
            for m in INNER.finditer(piece):
                if m.start() - start >= long_piece:
                    cut.append(piece[start : m.start()])
                    start = m.start()
        cut.append(piece[start:])
    return cut


class Lengths:
    """Token counts of texts. ``path``: a tokenizers ``.json`` file or a sentencepiece ``.model`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.split = False  # its normaliser looks across white space
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.split = type(model.pre_tokenizer).__name__ == "ByteLevel" and model.normalizer is None

    def _in_calls(self, texts: Iterable[str]) -> Iterator[tuple[str, int]]:
        call: list[str] = []
        held = 0
        for text in texts:
            size = len(text) if text.isascii() else len(text.encode())
            if call and held + size > CALL_BYTES:
                yield from zip(call, self.encode(call), strict=True)
                call, held = [], 0
            call.append(text)
            held += size
        if call:
            yield from zip(call, self.encode(call), strict=True)

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [n for _, n in self._in_calls(texts)]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = [pieces(t) for t in texts]
        new = {p for parts in cut for p in parts if p not in memo}
        memo.update(self._in_calls(new))
        out = [sum(map(memo.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > 64:  # long pieces hardly come again
                del memo[p]
        return out


@lru_cache(maxsize=2)
def lengths_of(path: str) -> Lengths:
    """One per worker process and model, with its memo."""
    return Lengths(path)


def token_counts(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens). Every row gives one row, repeated rows and null ids
    too, an empty table an empty result; other columns are ignored, whatever their names. Very long texts are encoded
    piece by piece and count in full. No shuffle: a map over the scan.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = lengths.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    part = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return map_arrow(part, run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents`` for byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
