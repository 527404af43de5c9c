"""Vectors: the built-in hashed text embedding (C4/K2) and cosine.

The embedding model of the reference is a remote service; here the caller may
pass any ``Column -> Column`` embedder (for example an iterator pandas UDF
that loads a model once per task). The default is a deterministic stand-in:
feature hashing of the tokens into ``dim`` buckets, counted and L2-normalised.
Tokens are cut in the JVM; an Arrow UDF hashes the distinct words of a slice of
rows and counts the buckets (one ``np.bincount`` a slice).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import tokens

DEFAULT_DIM = 64
SLICE_TOKENS = 500_000     # tokens turned into numbers at a time


def _buckets_of(words: pa.Array, dim: int) -> np.ndarray:
    """bucket(t) = first 32 bits of md5(t), as an unsigned number, mod dim."""
    return np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % dim for t in words.to_pylist()], np.int64)


def unit_counts(toks: pa.Array, dim: int = DEFAULT_DIM) -> pa.Array:
    """Token lists -> unit vectors of bucket counts; null for a list without a
    token. A word is hashed once per slice of ``SLICE_TOKENS``, and no more than
    a slice is held as numbers."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, start = [pa.array([], pa.list_(pa.float32()))], 0
    while start < len(toks):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        sizes = np.diff(ends[start:stop], prepend=before)
        words = toks.slice(start, stop - start).flatten().dictionary_encode()
        at = _buckets_of(words.dictionary, dim)[words.indices.to_numpy(zero_copy_only=False)]
        some = sizes > 0
        at += np.repeat(np.arange(some.sum()) * dim, sizes[some])
        counts = np.bincount(at, minlength=int(some.sum()) * dim).reshape(-1, dim).astype(np.float64)
        unit = (counts / np.sqrt((counts * counts).sum(1, keepdims=True))).astype(np.float32)
        offsets = np.append(0, np.cumsum(some) * dim).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.reshape(-1)), mask=pa.array(~some)))
        start = stop
    return pa.concat_arrays(out)


@lru_cache(maxsize=None)
def _unit_counts_udf(dim: int):
    @F.arrow_udf("array<float>")
    def embed(toks: pa.Array) -> pa.Array:
        return unit_counts(toks, dim)
    return embed


def hash_embed(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<float> of length ``dim`` with unit norm; null for text with no token."""
    return _unit_counts_udf(dim)(tokens(text))
