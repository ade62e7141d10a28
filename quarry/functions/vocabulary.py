"""Sparse vectors from a tokenizer's vocabulary file, for documents and for queries."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from quarry.plans import nodes as N

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """This process's tokenizer of a file that every executor has; no truncation, no padding."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def token_counts(text: Column, path: str) -> Column:
    """How often each token id stands in a text: array<struct<dim:int,weight:float>>, by id; empty for a null text."""

    @F.arrow_udf("array<struct<dim:int,weight:float>>")
    def counts(texts: pa.Array) -> pa.Array:
        dims, weights, ends = [], [], [0]
        for some in (texts[i : i + 256].to_pylist() for i in range(0, len(texts), 256)):
            for encoding in tokenizer(path).encode_batch_fast([x or "" for x in some], add_special_tokens=False):
                ids, n = np.unique(np.array(encoding.ids, np.int32), return_counts=True)
                dims.append(ids), weights.append(n.astype(np.float32)), ends.append(ends[-1] + len(ids))
        flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([flat(dims, pa.int32()), flat(weights, pa.float32())], ["dim", "weight"]))

    return counts(text)


def sparse_query(field: str, text: str, path: str, idf: Mapping[int, float] | None = None, by_count: bool = False) -> N.Sparse:
    """A text as a sparse query: its distinct token ids with weight one (by_count: how often they stand), times their idf if that is given."""
    counts = Counter(tokenizer(path).encode(text, add_special_tokens=False).ids)
    return N.Sparse(field, tuple((i, float(n if by_count else 1) * (1.0 if idf is None else float(idf.get(i, 0.0)))) for i, n in sorted(counts.items())))
