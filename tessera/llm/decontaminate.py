"""Operator 2: benchmark decontamination by latent semantic retrieval.

Passages are runs of words; their TF-IDF rows, over terms hashed to a fixed width, are
never held together.  One pass sums the document frequencies of all passages; a second
sums C @ omega, where C is the Gram matrix of all rows and omega a random matrix, from which the Nystroem form of the randomised SVD gives the leading
right singular vectors and values.  A third pass projects every window of every text, finds the benchmark items
whose cosine is high enough for a window that holds them, passes over candidates that
share no rare word with the item, and settles each other one on the words around it: the longest common subsequence must cover most of the item, or
a good part of it together with the item's answer (its last words).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.set_join import tree_sum

from .shared import PLAIN, hash_words, materialize, small_batches, table, text_slices, unused

_BLOCKS = 16


class Settings(NamedTuple):
    terms: int = 8192  # width that terms are hashed to
    rank: int = 48
    drop: int = 6  # leading directions left out: they tell languages apart, not texts
    oversampling: int = 10
    block: int = 16  # words; a window is two neighbouring blocks
    cosine: float = 0.42  # of what a window that holds the item is expected to have
    rare: float = 0.005  # share of passages up to which a word of the benchmark is rare
    rare_words: int = 2  # that a window and an item must share, where the item has them
    sure: float = 0.75  # share of the item's words in the common subsequence that settles it alone
    paraphrase: float = 0.55  # share that settles it together with the answer
    answer_words: int = 6
    answer_share: float = 0.6
    least_words: int = 6  # of an item; shorter ones are not looked for
    most_items: int = 100_000  # items that are sent to every task; more are looked for in several passes


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    answer: frozenset


class Blocks(NamedTuple):
    terms: np.ndarray  # a word each
    first: np.ndarray  # first word of each block and one more
    doc: np.ndarray  # document of each block
    words: object


# fixed values: UTF-8 capitals of two bytes: first byte, second bytes from and to, first byte of the small letter, shift of the second
_CAPITALS = (
    (0xC3, 0x80, 0x96, 0xC3, 0x20), (0xC3, 0x98, 0x9E, 0xC3, 0x20),  # Latin-1
    (0xCE, 0x91, 0x9F, 0xCE, 0x20), (0xCE, 0xA0, 0xAB, 0xCF, -0x20),  # Greek
    (0xD0, 0x90, 0x9F, 0xD0, 0x20), (0xD0, 0xA0, 0xAF, 0xD1, -0x20), (0xD0, 0x80, 0x8F, 0xD1, 0x10),  # Cyrillic
)


def plain_words(buf: np.ndarray, offsets: np.ndarray):
    """Words in lower case without ASCII marks; accented Latin-1, Greek and Cyrillic capitals are lowered too."""
    lead = np.flatnonzero(buf[:-1] >= 0xC3)
    if len(lead):
        first, second, out = buf[lead], buf[lead + 1], buf.copy()
        for capital, low, high, small, shift in _CAPITALS:
            at = np.flatnonzero((first == capital) & (second >= low) & (second <= high))
            out[lead[at]], out[lead[at] + 1] = small, (second[at].astype(np.int16) + shift).astype(np.uint8)
        buf = out
    return hash_words(buf, offsets, lower=True, fold=PLAIN)


def _blocks(buf: np.ndarray, offsets: np.ndarray, s: Settings) -> Blocks:
    w = plain_words(buf, offsets)
    count = np.diff(w.first)
    number = -(-count // s.block)
    doc = np.repeat(np.arange(len(count)), number)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    return Blocks((w.hashes >> np.uint64(17)).astype(np.int64) % s.terms, np.append(w.first[doc] + nth * s.block, w.first[-1]), doc, w)


def _passages(b: Blocks) -> np.ndarray:
    """The passage of each block: two blocks of a document make one."""
    nth = np.arange(len(b.doc)) - np.searchsorted(b.doc, b.doc)
    new = np.ones(len(b.doc), bool)
    new[1:] = (b.doc[1:] != b.doc[:-1]) | (nth[1:] % 2 == 0)
    return np.cumsum(new) - 1


def _places(sorted_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in sorted_words, -1 for none."""
    if not len(sorted_words):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_words, hashes), len(sorted_words) - 1)
    return np.where(sorted_words[at] == hashes, at, -1)


def _counts(s: Settings, words: np.ndarray):
    """Passages that hold each hashed term, all passages, and occurrences of each of words."""

    def run(batches):
        total = np.zeros(s.terms + 1 + len(words), np.int64)
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column(0)):
                b = _blocks(buf, offsets, s)
                if len(b.doc):
                    passage = np.repeat(_passages(b), np.diff(b.first))
                    seen = np.unique(passage * s.terms + b.terms)
                    total[: s.terms] += np.bincount(seen % s.terms, minlength=s.terms)
                    total[s.terms] += passage[-1] + 1
                    at = _places(words, b.words.hashes)
                    total[s.terms + 1 :] += np.bincount(at[at >= 0], minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    return run


def _sketch(s: Settings, idf: np.ndarray, omega: np.ndarray):
    def run(batches):
        total = np.zeros((s.terms, omega.shape[1]))
        weighted = (omega * idf[:, None]).astype(np.float32)
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column(0)):
                b = _blocks(buf, offsets, s)
                if not len(b.doc):
                    continue
                passage = _passages(b)
                first = b.first[:-1][np.concatenate(([True], passage[1:] != passage[:-1]))]
                size = np.diff(np.append(first, b.first[-1]))
                terms = b.terms
                norm = np.add.reduceat(idf[terms] ** 2, first)  # rows of unit length, but for repeated words
                # the longest passages first, so that those with a k-th word are the first ones
                by = np.argsort(-size, kind="stable")
                first, size, norm = first[by], size[by], norm[by]
                y = np.zeros((len(first), omega.shape[1]), np.float32)
                for k in range(int(size[0])):
                    n = int(np.searchsorted(-size, -k, "left"))
                    y[:n] += np.take(weighted, terms[first[:n] + k], 0)
                y /= np.maximum(norm, 1e-9).astype(np.float32)[:, None]
                row = np.empty(len(by), np.int64)
                row[by] = np.arange(len(by))
                of_word = row[np.repeat(np.arange(len(by)), size[row])]
                order = np.argsort(terms.astype(np.uint16) if s.terms <= 1 << 16 else terms, kind="stable")  # short numbers sort by radix
                for c in range(0, len(order), 8192):  # what is gathered stays in the cache
                    some = order[c : c + 8192]
                    own = terms[some]
                    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    total[own[start]] += np.add.reduceat(np.take(y, of_word[some], 0), start, axis=0) * idf[own[start]][:, None]
        task = TaskContext.get().partitionId()
        for k, part in enumerate(np.array_split(total, _BLOCKS)):
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "block": pa.array([k], pa.int32()), "sums": [part.astype("<f8").tobytes()]})

    return run


class Space(NamedTuple):
    weights: np.ndarray  # terms x rank, float32: idf, singular vectors, scaled to unit singular values
    rare: np.ndarray  # those of the benchmark's words that are rare, sorted


def fit_space(docs: DataFrame, text_col: str = "text", s: Settings = Settings(), seed: int = 7, words: np.ndarray = np.zeros(0, np.uint64)) -> Space | None:
    """The latent space of the texts' passages, and which of words (sorted) are rare in them; None if there is no word."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = np.zeros(s.terms + 1 + len(words))
    for r in texts.mapInArrow(_counts(s, words), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms and the benchmark's words at most
        counts[r["term"]] = r["n"]
    df, passages, held = counts[: s.terms], counts[s.terms], counts[s.terms + 1 :]
    if not passages:
        return None
    idf = np.log((1 + passages) / (1 + df)) + 1
    omega = np.random.Generator(np.random.PCG64(seed)).standard_normal((s.terms, s.rank + s.drop + s.oversampling))
    z = np.concatenate(tree_sum(texts.mapInArrow(_sketch(s, idf, omega), "task int, block int, sums binary"))).reshape(s.terms, -1)
    core = omega.T @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > values[-1] * 1e-9
    u, sigma, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    rank = int(np.count_nonzero(sigma > sigma[0] * 1e-6))
    # a small corpus may have no more directions than are left out
    use = slice(s.drop, s.drop + s.rank) if rank >= s.drop + s.rank else slice(0, rank)
    return Space((idf[:, None] * u[:, use] / sigma[use]).astype(np.float32), words[held <= np.maximum(s.rare * passages, 20)])


def common_subsequence(a: list[int], places: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of a and a sequence of which places has each word's positions as bits."""
    full = (1 << length) - 1
    v = full
    for x in a:
        m = places.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def benchmark_items(benchmark: DataFrame, s: Settings, id_col: str = "item_id", text_col: str = "text") -> list[Item]:
    out = []
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).collect():  # most_items or so
        data = r["t"].encode()
        h = plain_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes
        if len(h) >= s.least_words:
            out.append(Item(r["i"], h, frozenset(h[-s.answer_words :].tolist())))
    return out


def _search(items: list[Item], space: Space, s: Settings):
    def run(batches) -> Iterator[pa.RecordBatch]:
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
        term = lambda h: (h >> np.uint64(17)).astype(np.int64) % s.terms
        latent = unit(np.stack([space.weights[term(x.words)].sum(0) for x in items]))
        size = np.array([len(x.words) for x in items])
        window = 2 * s.block
        bar = s.cosine * np.sqrt(np.minimum(size, window) / np.maximum(size, window))
        bits: list[dict[int, int]] = []
        for x in items:
            at: dict[int, int] = {}
            for k, word in enumerate(x.words.tolist()):
                at[word] = at.get(word, 0) | 1 << k
            bits.append(at)
        # rare words to items, and how many of them a window must share
        places = [np.unique(_places(space.rare, x.words)) for x in items]
        places = [x[x >= 0] for x in places]
        need = np.array([min(s.rare_words, len(x)) for x in places])
        word, item_of = np.concatenate(places), np.repeat(np.arange(len(items)), [len(x) for x in places])
        order = np.argsort(word, kind="stable")
        item_of, item_start = item_of[order], np.searchsorted(word[order], np.arange(len(space.rare) + 1))
        for batch in batches:
            ids, out = batch.column(0), {}
            for i, _, buf, offsets in text_slices(batch.column(1)):
                b = _blocks(buf, offsets, s)
                if not len(b.doc):
                    continue
                sums = np.add.reduceat(space.weights[b.terms], b.first[:-1], axis=0)
                pair = np.flatnonzero(b.doc[1:] == b.doc[:-1])
                alone = np.flatnonzero(np.bincount(b.doc, minlength=b.doc[-1] + 1)[b.doc] == 1)
                start = np.concatenate((pair, alone))
                seen = unit(np.concatenate((sums[pair] + sums[pair + 1], sums[alone])))
                hashes = b.words.hashes
                found = _places(space.rare, hashes)
                at_word = np.flatnonzero(found >= 0)
                n_items = np.diff(item_start)[found[at_word]]
                hit = np.repeat(item_start[found[at_word]] - np.cumsum(n_items) + n_items, n_items) + np.arange(int(n_items.sum()))
                key = np.repeat((np.searchsorted(b.first, at_word, "right") - 1) * len(items), n_items) + item_of[hit]
                key, times = np.unique(np.concatenate((key, key - len(items))), return_counts=True)  # a block is in the window it begins and the one before
                key = key[times >= need[key % len(items)]]
                for c in range(0, len(seen), 4096):
                    near = np.argwhere(seen[c : c + 4096] @ latent.T >= bar)
                    near = near[(need[near[:, 1]] == 0) | (_places(key, start[c + near[:, 0]] * len(items) + near[:, 1]) >= 0)]
                    for w, item in near.tolist():
                        block, x = start[c + w], items[item]
                        doc = int(b.doc[block])
                        n, at = len(x.words), bits[item]
                        if out.get((i + doc, item), (0,))[0] == n:
                            continue
                        a, z = max(b.words.first[doc], b.first[block] - n), min(b.words.first[doc + 1], b.first[block] + window + n)
                        around = hashes[a:z].tolist()
                        held = set(around)
                        if sum(word in held for word in at) < s.paraphrase * len(at) * 0.9:
                            continue
                        lcs = common_subsequence(around, at, n)
                        answer = len(x.answer & held) / len(x.answer)
                        if lcs >= s.sure * n or lcs >= s.paraphrase * n and answer >= s.answer_share:
                            if lcs > out.get((i + doc, item), (0,))[0]:
                                out[i + doc, item] = lcs, n, answer
            if out:
                keys = sorted(out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([k for k, _ in keys])), pa.array([items[x].item_id for _, x in keys], pa.int64()), *(pa.array([out[k][p] for k in keys], t) for p, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64())))],
                    ["doc_id", "item_id", "lcs_words", "item_words", "answer_share"],
                )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, lcs_words, item_words, answer_share): a row for each item found in a row of docs.

    Words are runs of letters, digits and non-ASCII bytes, in lower case.  Null, empty and
    blank texts hold nothing; null items and those of fewer than least_words words are
    not looked for; a benchmark without items, or docs without words, give no rows.
    Repeated rows and items each give rows of their own; a null id stays null; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, lcs_words long, item_words long, answer_share double"
    passes = -(-benchmark.count() // s.most_items)
    out = docs.sparkSession.createDataFrame([], schema)
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else benchmark
        items = benchmark_items(part, s)
        space = fit_space(docs, text_col, s, words=np.unique(np.concatenate([x.words for x in items]))) if items else None
        if space is not None:
            found = rows.mapInArrow(_search(items, space, s), schema)
            out = found if k == 0 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs whose id no item was found in; rows of a null id stay."""
    (name,) = unused(docs, "_found")
    found = materialize(find_contamination(docs, benchmark, id_col, text_col, s).select(F.col("doc_id").alias(name)).distinct(), "found")
    return docs.join(found, docs[id_col] == found[name], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every whole document."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
