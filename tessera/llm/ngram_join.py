"""Operator 1: n-gram Jaccard join of documents' word shingles, by the join of sets in tessera.operators.set_join.

Sets are compared by 64-bit hashes of words, shingles and sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.set_join import SKETCH, _step, jaccard_join, overlap_of, part_keys

from .shared import hash_words, mix, table, text_slices, unused

__all__ = ["SKETCH", "overlap_of", "part_keys"]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a null, empty or blank text."""
    for _, _, buf, offsets in text_slices(column):
        w = hash_words(buf, offsets, lower=True)
        h, first = w.hashes, w.first
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled += h[k : k + len(rolled)] * _step(k)
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif b > a:
                yield mix(np.array([sum(int(x) * int(_step(k)) for k, x in enumerate(h[a:b])) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: str = "0.8") -> DataFrame:
    """(doc_id, n_shingles, component_id): each row's set size and the smallest id that links reach.

    Null, empty and blank texts have an empty set and are linked with nothing: their
    component is their own id.  Texts of fewer words than width are one shingle.
    Rows of equal sets, repeated rows and ids among them, share a component; a null id
    counts as larger than any other, and stays null where it stands alone.  Other
    columns are ignored; an empty table gives no rows.  Connectivity is exact: every
    link between different sets is found or follows from links that were.
    """
    return jaccard_join(docs, id_col, text_col, functools.partial(shingle_sets, width=width), similarity)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; of repeated rows with that id all stay."""
    (name,) = unused(docs, "_kept")
    kept = ngram_jaccard_join(docs, id_col, text_col, **params).where("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every whole document, at five words and a similarity of 0.8."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
