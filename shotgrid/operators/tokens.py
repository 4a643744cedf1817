"""Tokens (E1-E4): a corpus vocabulary built by distributed counting, encoding by a
broadcast lookup, padding/truncation and decoding as array expressions.

Token rule: maximal runs of letters of any script in the lower-cased text (the same rule in Spark
and DuckDB).  Subword ids by a pre-trained vocabulary are in ``operators.subword``.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_PATTERN = r"\p{L}+"
PAD, UNK, EOS = 0, 1, 2
N_SPECIAL = 3

def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def build_vocab(corpus: DataFrame, size: int, text: str = "text", always: Sequence[str] = ()) -> DataFrame:
    """The ``size`` most frequent tokens (count desc, token asc) and the words of
    ``always`` (count 0 if absent), ids from ``N_SPECIAL``.  The count is a partial
    (map-side) aggregation, so a Zipfian hot token ships one row per partition; the
    top-``size`` is TakeOrderedAndProject."""
    counts = corpus.select(F.explode(tokens(text)).alias("token")).groupBy("token") \
                   .agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(size)
    if always:
        words = corpus.sparkSession.createDataFrame([(w, 0) for w in sorted(set(always))], "token string, n long")
        seen = counts.filter(F.col("token").isin(*always))
        top = top.unionByName(seen).unionByName(words).groupBy("token").agg(F.max("n").alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col("token"))  # over the vocabulary only: its size is a parameter
    return top.withColumn("token_id", (F.row_number().over(w) - 1 + N_SPECIAL).cast("int"))


def _vocab_table(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """(tokens, ids) of the vocabulary for a broadcast; its size is its parameter."""
    t = vocab.select("token", "token_id").toArrow().combine_chunks()
    return t["token"].combine_chunks(), t["token_id"].combine_chunks().cast(pa.int32())


def _relist(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists as long as ``lists`` (null as empty) over ``values``."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def encode(df: DataFrame, vocab: DataFrame, key: str = "id", **columns: str) -> DataFrame:
    """Text -> token ids in text order; unknown tokens -> UNK.  ``columns`` maps each
    output column to its text column, all in one pass.

    Tokenisation is the JVM regex (the same as ``build_vocab``); the ids of a whole Arrow
    batch are one hash lookup in the broadcast vocabulary, so no token occurrence is
    shuffled and no Python runs per token."""
    bc = df.sparkSession.sparkContext.broadcast(_vocab_table(vocab))

    @F.arrow_udf("array<int>")
    def lookup(toks: pa.Array) -> pa.Array:
        words, ids = bc.value
        found = pc.index_in(toks.flatten(), value_set=words)
        return _relist(toks, pc.fill_null(ids.take(found), UNK))

    return df.select(key, *[lookup(tokens(text)).alias(out) for out, text in columns.items()])


def pad_truncate(ids, max_length: int, side: str = "right") -> tuple[Column, Column]:
    """Truncate from the right to ``max_length``, pad to exactly ``max_length`` on
    ``side``; returns (ids, attention_mask)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    t = F.slice(c, 1, max_length)
    n_pad = (F.lit(max_length) - F.size(t)).cast("int")
    pad, ones, zeros = F.array_repeat(F.lit(PAD), n_pad), F.array_repeat(F.lit(1), F.size(t)), \
        F.array_repeat(F.lit(0), n_pad)
    if side == "left":
        return F.concat(pad, t), F.concat(zeros, ones)
    return F.concat(t, pad), F.concat(ones, zeros)


def decode_suffix(df: DataFrame, vocab: DataFrame, generated: str, prompt_len: int,
                  key: str = "id", out: str = "generated_text") -> DataFrame:
    """Drop the prompt's ``prompt_len`` ids, skip special ids, map ids to tokens and
    join them with spaces (empty string when nothing is left); map-only."""
    bc = df.sparkSession.sparkContext.broadcast(_vocab_table(vocab))
    rest = F.greatest(F.size(F.col(generated)) - prompt_len, F.lit(0))
    suffix = F.filter(F.slice(F.col(generated), F.lit(prompt_len + 1), rest), lambda x: x >= F.lit(N_SPECIAL))

    @F.arrow_udf("array<string>")
    def words(lists: pa.Array) -> pa.Array:
        tokens_, ids = bc.value
        return _relist(lists, tokens_.take(pc.index_in(lists.flatten(), value_set=ids)))

    return df.select(key, F.array_join(words(suffix), " ").alias(out))


def choice_ids(vocab: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the allowed answer words (missing words are absent)."""
    return vocab.filter(F.col("token").isin(*[w.lower() for w in words])).select("token", "token_id")
