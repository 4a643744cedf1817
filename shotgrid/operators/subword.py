"""Subword tokens (E1, E3) by a pre-trained byte-level vocabulary, as the reference uses one.

The vocabulary file is a parameter; it is opened once per Python worker and never copied.  Byte-level pieces
cover every character of every script, so decoding gives the text back.  Strings of special tokens inside a text
are plain text.  Null texts are empty.

Where the same vocabulary is also kept as ranks, ``tiktoken`` computes the ids (a test holds them equal) and a
batch is decoded as one Arrow lookup; a text or an id that these can't take goes to ``tokenizers``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENED: dict[str, object] = {}
_RANKED: dict[str, tuple[object, pa.Array]] = {}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> tuple[str, str]:
    """(the vocabulary of ``default_file`` as ranks, the pattern that cuts a text into words)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer(file: str):
    if file not in _OPENED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        t.encode_special_tokens = True
        _OPENED[file] = t
    return _OPENED[file]


def _ranked(ranks: tuple[str, str]) -> tuple[object, pa.Array]:
    """(encoding, the bytes of every id) of a vocabulary kept as ranks; one per Python worker."""
    if ranks[0] not in _RANKED:
        import tiktoken

        with open(ranks[0], "rb") as f:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        pieces: list[bytes | None] = [None] * (max(merges.values()) + 1)
        for piece, rank in merges.items():
            pieces[rank] = piece
        _RANKED[ranks[0]] = (tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=merges, special_tokens={}),
                             pa.array(pieces, pa.large_binary()))
    return _RANKED[ranks[0]]


def _encoder(file: str, ranks: tuple[str, str] | None) -> Callable[[str], np.ndarray]:
    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer(file).encode(text, add_special_tokens=False).ids, np.int32)

    if ranks is None:
        return slow
    fast = _ranked(ranks)[0]

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except Exception:  # noqa: BLE001 - the regular expression engine gave up on this text
            return slow(text)

    return encode


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _looked_up(lists: pa.Array, pieces: pa.Array) -> pa.Array | None:
    """The texts of a batch by the bytes of its ids; None where ``pieces`` lacks an id or a text is cut inside a character."""
    ids = lists.flatten()
    values = ids.to_numpy(zero_copy_only=False) if not ids.null_count else None
    if values is None or len(values) and (values.min() < 0 or values.max() >= len(pieces)):
        return None
    found = pieces.take(ids)
    if found.null_count:
        return None
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    starts = ends[_offsets(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
    out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(starts), found.buffers()[2] or pa.py_buffer(b""))
    try:
        out.validate(full=True)                          # every text is UTF-8 by itself
    except pa.ArrowInvalid:
        return None
    return out.cast(pa.string())


def encode(df: DataFrame, file: str, text: str, out: str, ranks: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out``, the ids of ``text``.  ``ranks``: the same vocabulary as ranks, with its pattern."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        ids_of = _encoder(file, ranks)
        each = [ids_of(x.as_py()).astype(np.int32) for x in texts]
        values = np.concatenate(each) if each else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(_offsets([len(x) for x in each]), pa.int32()), pa.array(values, pa.int32()))

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, file: str, ids: str, out: str, ranks: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out``, the text of the ids.  ``ranks``: the same vocabulary as ranks, with its pattern."""
    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        known = None if ranks is None else _looked_up(lists, _ranked(ranks)[1])
        if known is not None:
            return known
        t = tokenizer(file)
        return pa.array([t.decode(x.as_py() or [], skip_special_tokens=False) for x in lists], pa.string())

    return df.withColumn(out, texts(F.col(ids)))
