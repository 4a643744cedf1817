"""Operator 4: sum-of-squares online packing of documents into sequences of ``LENGTH`` tokens.

A document's ids (with id 0 behind them) fill as many whole sequences as they can; the rest is
one item.  Items are packed online: an array counts the open windows of each fill level, and an
item goes to the level (or opens a window) that makes the sum of the squared counts smallest,
ties to the fullest window.  Every task packs its own rows, so nothing is shuffled and the level
array is all the state.  At the end of a task the windows still open are filled from the
emptiest ones, whose pieces are cut, and what is left becomes sequences of powers of two, which
need no padding.  A sequence's id holds the task's number, so ids are unique and a rerun task
gives the same rows.

Ids are those of the tokenizer file; ``tiktoken`` computes them from the same vocabulary kept as
ranks (five times as fast as ``tokenizers``; a test holds them equal), and a text it can't take
goes to ``tokenizers``.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each; equal
levels are used last-in first-out; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm.common import documents, freeing

LENGTH = 1024
END_ID = 0
TASK_BITS = 36                       # a sequence id is task << TASK_BITS | number in the task
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_ENCODERS: dict[str, object] = {}


def default_tokenizer() -> tuple[str, str]:
    """(tokenizer file, the same vocabulary as ranks)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str]):
    """text -> numpy array of ids; one per Python worker."""
    if files[0] not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(files[0])
        slow.encode_special_tokens = True

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # noqa: BLE001 - the regular expression engine gave up on this text
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[files[0]] = encode
    return _ENCODERS[files[0]]


class Packer:
    """Open windows by fill level.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]
        self.closed: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.closed.append([(doc_id, at, ids[at:at + self.length], n)])
        if whole < n:
            self._place((doc_id, whole, ids[whole:], n))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        n, top = self.count, self.length - size
        # change of the sum of squares, halved: from level h to level h + size (0: a new window)
        cost = n[size:self.length + 1] - n[:top + 1] + 1.0
        cost[0] = n[size] + 0.5
        cost[top] = 0.5 - n[top] if top else cost[top]      # the window closes
        cost[1:][n[1:top + 1] == 0] = np.inf
        level = top - int(np.argmin(cost[::-1]))
        window = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
        window.append(piece)
        if level + size == self.length:
            self.closed.append(window)
        else:
            n[level + size] += 1
            self.open[level + size].append(window)

    def finish(self) -> None:
        """Fills the fullest open windows with cut pieces of the emptiest; the last few tokens
        become sequences of powers of two."""
        left = [(h, w) for h in range(self.length) for w in self.open[h]]      # emptiest first
        self.open, self.count[:] = [[] for _ in range(self.length + 1)], 0
        pool: list[tuple] = []
        while left:
            fill, window = left.pop()
            while fill < self.length and (pool or left):
                if not pool:
                    pool = left.pop(0)[1]
                doc_id, start, ids, n = pool.pop()
                take = min(len(ids), self.length - fill)
                window.append((doc_id, start, ids[:take], n))
                fill += take
                if take < len(ids):
                    pool.append((doc_id, start + take, ids[take:], n))
            if fill == self.length:
                self.closed.append(window)
            else:
                pool = window
        total = sum(len(p[2]) for p in pool)
        while total:
            size = min(self.length, 1 << (total.bit_length() - 1))
            window, fill = [], 0
            while fill < size:
                doc_id, start, ids, n = pool.pop()
                take = min(len(ids), size - fill)
                window.append((doc_id, start, ids[:take], n))
                fill += take
                if take < len(ids):
                    pool.append((doc_id, start + take, ids[take:], n))
            self.closed.append(window)
            total -= size

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def pack(docs: DataFrame, files: tuple[str, str] | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids (``input_ids``)."""
    files = files or default_tokenizer()

    def rows(windows: list[list], first: int) -> pa.RecordBatch:
        out = []
        for k, window in enumerate(windows):
            offset = 0
            for doc_id, start, ids, n in window:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + k, offset)
                           + ((ids.astype(np.int32),) if with_ids else ()))
                offset += len(ids)
        cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)],
                                          names=[n for n, _ in fields])

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    fields = [(n, pa.int64()) for n in names] + ([("input_ids", pa.list_(pa.int32()))] if with_ids else [])

    def run(batches):
        encode, packer = encoder(files), Packer(length)
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                packer.add(doc_id, np.append(encode(text), np.uint32(END_ID)) if text else np.array([END_ID], np.uint32))
                if len(packer.closed) >= 4096:
                    windows = packer.take()
                    yield rows(windows, number)
                    number += len(windows)
        packer.finish()
        windows = packer.take()
        if windows:
            yield rows(windows, number)

    schema = SCHEMA + (", input_ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), schema)


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)


QUERIES = {"op4_sum_of_squares_packing": op4_sum_of_squares_packing}
