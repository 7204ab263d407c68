"""Operator 3: scoring with a causal self-attention model, trained in numpy.

The model reads subword ids.  The most frequent ids are classes of their own, the rest
share classes by rank; classes lie in a square, of which a row holds classes that follow
the same ones.  The hidden state of a place joins the embeddings of the last two
subwords and what one attention layer gathers from the window; it gives the row of the
next class, then its column, and corpus counts give the id within its class.  The two
output layers start from the corpus's class bigrams, counted over every training subword.

A text is cut into blocks; a window is a block and the one before it, so windows overlap by
a block and every subword is scored once, with at least a block of context where there is
one.  A text's score is the sum over its subwords and its end: the model's alone, a
distribution over ids at every place.

Texts are tokenised once, in buckets that a task forms of its own rows: packets of the bucket's
words with their counts, subword counts, and the line of subwords of every text.  Training
runs on every line of the training texts, cut into windows that predict each subword
once.  Lines are dealt to rounds; in a round tasks train from the same weights, and the
mean of theirs, by what they saw, begins the next.  The base score needs the words' counts
in all training texts: packets meet by their part of the hash space, and the totals go back
to their buckets, so no task or driver holds the corpus's vocabulary.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import _BLOCKS, tree_sum
from .packing import forget_words, hashed_words
from .shared import discard, hash_words, materialize, small_batches, table, text_slices


class Shape(NamedTuple):
    side: int = 32  # classes form a square: the row is predicted first, then the column
    shared: int = 64  # classes, of side squared, that many ids share; each other one is an id
    width: int = 8
    hidden: int = 16
    block: int = 16
    rounds: int = 2  # each line is in one of them
    batch: int = 96  # windows
    least_steps: int = 300  # of a task in a round; it goes over its windows again until then
    rate: float = 0.02
    smoothing: float = 0.1  # of the ids in a class
    discount: float = 0.75  # of the counts of class bigrams
    end: int = 49407  # the id before and after a text
    vocabulary: int = 49408
    bucket_bytes: int = 8 << 20  # text that a task holds at once
    fold: int = 10  # ids whose crc32 modulo fold is 0 are held out


class Classes(NamedTuple):
    of_id: np.ndarray  # class of each id
    log_share: np.ndarray  # log10 of the id's share of its class


class Prior(NamedTuple):
    """What the output layers start from: logarithms of class bigram shares."""

    row: np.ndarray  # of the next row, by class
    col: np.ndarray  # of the next column, by class and row


Weights = dict[str, np.ndarray]


def make_classes(counts: np.ndarray, s: Shape) -> Classes:
    order = np.argsort(-counts, kind="stable")
    of_id = np.empty(s.vocabulary, np.intp)
    rank, single = np.arange(s.vocabulary), s.side**2 - s.shared
    # the rest by the logarithm of the rank, so that each class has about as much weight
    rest = single + (np.log(np.maximum(rank - single, 0) + 1) / math.log(s.vocabulary) * s.shared).astype(np.intp)
    of_id[order] = np.where(rank < single, rank, np.minimum(rest, s.side**2 - 1))
    smooth = counts + s.smoothing
    total = np.bincount(of_id, smooth, minlength=s.side**2)
    return Classes(of_id, np.log10(smooth / total[of_id]))


def _halves(members: np.ndarray, features: np.ndarray, groups: int, side: int) -> list[np.ndarray]:
    """members in groups of side alike ones, by cuts across the widest direction."""
    if groups == 1:
        return [members]
    own = features[members] - features[members].mean(0)
    members = members[np.argsort(own @ np.linalg.svd(own, full_matrices=False)[2][0], kind="stable")]
    cut = groups // 2 * side
    return _halves(members[:cut], features, groups // 2, side) + _halves(members[cut:], features, groups - groups // 2, side)


def arrange(classes: Classes, bigrams: np.ndarray, s: Shape) -> tuple[Classes, Prior]:
    """Classes that follow the same ones share a row; the prior of class bigrams."""
    k = s.side**2
    profile = np.sqrt(bigrams / np.maximum(bigrams.sum(0), 1))
    draw = np.random.Generator(np.random.PCG64(3)).standard_normal((k, min(k, 40)))
    basis = np.linalg.svd(profile.T @ (profile @ draw), full_matrices=False)[0][:, :24]
    features = profile.T @ (profile @ basis)
    features /= np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-9)
    place = np.empty(k, np.intp)
    place[np.concatenate(_halves(np.arange(k), features, s.side, s.side))] = np.arange(k)
    moved = np.empty_like(bigrams)
    moved[np.ix_(place, place)] = bigrams
    alone = moved.sum(0) + 0.01
    alone /= alone.sum()
    # absolute discounting: what is taken from the seen pairs goes to the next class alone
    n, kinds = moved.sum(1, keepdims=True), (moved > 0).sum(1, keepdims=True)
    share = np.where(n > 0, (np.maximum(moved - s.discount, 0) + s.discount * kinds * alone) / np.maximum(n, 1), alone)
    square = (share / share.sum(1, keepdims=True)).reshape(k, s.side, s.side)
    of_row = square.sum(2)
    return Classes(place[classes.of_id], classes.log_share), Prior(np.log(of_row).astype(np.float32), np.log(square / of_row[:, :, None]).reshape(k * s.side, s.side).astype(np.float32))


def first_weights(s: Shape, seed: int = 11) -> Weights:
    rng = np.random.Generator(np.random.PCG64(seed))
    k, d, m = s.side, s.width, s.hidden
    normal = lambda scale, *size: (rng.standard_normal(size) * scale).astype(np.float32)
    deep = 1 / math.sqrt(d)
    # a: embeddings of the place and of the one before it, and what attention gathers
    return {"e": normal(0.5, k * k, d), "q": normal(deep, d, d), "k": normal(deep, d, d), "v": normal(deep, d, d), "far": np.zeros(2 * s.block, np.float32), "a": normal(deep / 4, 3 * d, m), "c": np.zeros(m, np.float32), "row": np.zeros((m, k), np.float32), "given_row": np.zeros((k, m), np.float32), "col": normal(0.1 / math.sqrt(m), m, k)}


def pack_weights(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack_weights(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


@functools.lru_cache(8)
def _gaps(queries: int, keys: int, most: int) -> np.ndarray:
    """The distance of query i (the last ones) and key j, at most most; most + 1 ahead."""
    gap = (np.arange(queries)[:, None] + keys - queries) - np.arange(keys)
    return np.where(gap >= 0, np.minimum(gap, most), most + 1)


def _causal(far: np.ndarray, queries: int, keys: int) -> np.ndarray:
    """Bias by distance of query and key; minus infinity ahead."""
    return np.append(far, far.dtype.type(-np.inf))[_gaps(queries, keys, len(far) - 1)]


def _bound(x: np.ndarray) -> np.ndarray:
    """x with a bound for large values, in place; to look for them is cheaper than to write."""
    if x.size and not x.max() <= 60:
        np.minimum(x, 60, out=x)
    return x


def _exp_sum(x: np.ndarray) -> np.ndarray:
    """x becomes its exponential, bounded; the sum over the last axis.

    A product with ones is several times faster than a sum over a short axis.
    """
    np.exp(_bound(x), out=x)
    return x @ np.ones((x.shape[-1], 1), x.dtype)


def _sum_by(keys: np.ndarray, values: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out[k]: the sum of the rows of values whose key is k."""
    width = values.shape[1]
    np.add.at(out.reshape(-1), (keys[:, None] * width + np.arange(width, dtype=keys.dtype)).ravel(), values.ravel())
    return out


@functools.lru_cache(8)
def _row_begins(rows: int, width: int) -> np.ndarray:
    return np.arange(rows) * width


def loss_and_gradient(w: Weights, x: np.ndarray, y: np.ndarray, valid: np.ndarray, prior: Prior | None = None, told: bool = True) -> tuple[float, Weights]:
    """Mean negative log-likelihood of classes y after x (windows x length), 0 if it need not be told, and its gradient."""
    n, length = x.shape
    d, side, kind = w["q"].shape[0], w["row"].shape[1], w["e"].dtype
    size, flat_x, flat_y = n * length, x.ravel(), y.ravel()
    e = np.take(w["e"], flat_x, 0)
    scale = kind.type(1 / math.sqrt(d))
    q, k, v = ((e @ z).reshape(n, length, d) for z in (w["q"] * scale, w["k"], w["v"]))
    att = q @ k.transpose(0, 2, 1)
    att += _causal(w["far"], length, length)
    att /= _exp_sum(att)
    o = att @ v
    given = np.empty((n, length, 3 * d), kind)
    given[:, :, :d] = e.reshape(n, length, d)
    given[:, 1:, d : 2 * d] = given[:, :-1, :d]
    given[:, 0, d : 2 * d] = 0
    given[:, :, 2 * d :] = o
    given = given.reshape(size, 3 * d)
    row, begin = flat_y // side, _row_begins(2 * size, side)
    share = (valid / max(1.0, float(valid.sum()))).astype(kind).ravel()
    # the states of the row above those of the column
    h = np.empty((2 * size, w["row"].shape[0]), kind)
    np.matmul(given, w["a"], out=h[:size])
    h[:size] += w["c"]
    np.add(h[:size], np.take(w["given_row"], row, 0), out=h[size:])
    r = np.maximum(h, 0)
    g = np.empty((2 * size, side), kind)
    np.matmul(r[:size], w["row"], out=g[:size])
    np.matmul(r[size:], w["col"], out=g[size:])
    if prior is not None:
        g[:size] += np.take(prior.row, flat_x, 0)
        g[size:] += np.take(prior.col, flat_x * side + row, 0)
    wanted, both, cells = begin + np.concatenate((row, flat_y - row * side)), np.concatenate((share, share)), g.reshape(-1)
    total = _exp_sum(g)
    loss = float((np.log(total[:, 0] / cells[wanted]) * both).sum()) if told else 0.0
    g *= both[:, None] / total
    cells[wanted] -= both
    gh = np.empty_like(h)
    np.matmul(g[:size], w["row"].T, out=gh[:size])
    np.matmul(g[size:], w["col"].T, out=gh[size:])
    gh *= r > 0
    hot = np.zeros((size, side), kind)
    hot.reshape(-1)[wanted[:size]] = 1
    out: Weights = {"row": r[:size].T @ g[:size], "col": r[size:].T @ g[size:], "given_row": hot.T @ gh[size:]}
    gh = gh[:size] + gh[size:]
    out["a"], out["c"] = given.T @ gh, np.ones(size, kind) @ gh
    back = (gh @ w["a"].T).reshape(n, length, 3 * d)
    ge, go = back[:, :, :d].copy(), back[:, :, 2 * d :].copy()
    ge[:, :-1] += back[:, 1:, d : 2 * d]
    gv = att.transpose(0, 2, 1) @ go
    gs = go @ v.transpose(0, 2, 1)
    gs -= ((go * o).reshape(size, d) @ np.ones((d, 1), kind)).reshape(n, length, 1)
    gs *= att
    far = len(w["far"])
    out["far"] = np.bincount(_gaps(length, length, far - 1).ravel(), gs.sum(0).ravel(), minlength=far)[:far].astype(kind)
    ge = ge.reshape(size, d)
    grads = np.empty((n, length, 3 * d), kind)
    np.matmul(gs, k * scale, out=grads[:, :, :d])
    np.matmul(gs.transpose(0, 2, 1), q, out=grads[:, :, d : 2 * d])
    grads[:, :, 2 * d :] = gv
    grads = grads.reshape(size, 3 * d)
    ge += grads @ np.concatenate((w["q"], w["k"], w["v"]), 1).T
    out |= zip("qkv", np.split(e.T @ grads, 3, 1))
    out["e"] = _sum_by(flat_x, ge, np.zeros_like(w["e"]))
    return loss, out


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.flat, self.rate, self.t = pack_weights(w), rate, 0
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        ends = np.cumsum([w[k].size for k in sorted(w)])[:-1]
        self.w = {k: x.reshape(w[k].shape) for k, x in zip(sorted(w), np.split(self.flat, ends), strict=True)}  # views

    def step(self, g: Weights) -> None:
        self.t += 1
        rate = np.float32(self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        x = pack_weights(g)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * x
        x *= x
        self.v *= np.float32(0.99)
        self.v += np.float32(0.01) * x
        self.flat -= rate * self.m / (np.sqrt(self.v) + np.float32(1e-8))


class Scorer:
    """Batched masked attention with the tables that depend on the class alone worked out before."""

    def __init__(self, w: Weights, classes: Classes, prior: Prior, s: Shape):
        self.s, self.classes, self.w, self.prior, d = s, classes, w, prior, s.width
        e = np.concatenate((w["e"], np.zeros((1, d), np.float32)))  # nothing stands before a text's first place
        self.q, self.k, self.v = e @ w["q"] / np.float32(math.sqrt(d)), e @ w["k"], e @ w["v"]
        self.a = [e @ w["a"][j * d : (j + 1) * d] for j in range(2)]
        self.a[0] += w["c"]
        self.out = w["a"][2 * d :]
        self.bias = _causal(w["far"], s.block, 2 * s.block)

    def log10(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the ids of texts, ids[first[k]:first[k + 1]], and of each text's end."""
        s, docs = self.s, len(first) - 1
        size = np.diff(first) + 1  # predicted tokens
        number = -(-size // s.block)
        base = np.concatenate(([0], np.cumsum(number)))
        doc = np.repeat(np.arange(docs), number)
        nth = np.arange(len(doc)) - base[doc]
        # tokens lie in rows of s.block, each text from a row's begin; the input is the end id and the text
        place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first)) + np.repeat(base[:-1] * s.block, np.diff(first))
        target = np.full(len(doc) * s.block, s.end, np.int64)
        target[place] = ids
        begin = base[:-1] * s.block
        # a text has a place more than ids, so its inputs stay inside it
        x = [np.full(len(target), s.side**2, np.intp) for _ in range(2)]
        x[0][:] = self.classes.of_id[s.end]
        x[0][place + 1] = self.classes.of_id[ids]
        x[1][1:] = x[0][:-1]
        x[1][begin] = s.side**2
        row, col = np.divmod(self.classes.of_id[target], s.side)
        got = np.empty(len(target), np.float32)
        blocks, chunk = x[0].reshape(-1, s.block), 192
        for a in range(0, len(doc), chunk):
            z = min(a + chunk, len(doc))
            some, n = slice(a * s.block, z * s.block), z - a
            seen = np.concatenate((x[0][max(0, a - 1) * s.block : max(1, a) * s.block], x[0][some]))

            def window(of_class: np.ndarray) -> np.ndarray:
                """Each block with the one before it: overlapping views of one gather."""
                flat = np.take(of_class, seen, 0)
                return np.lib.stride_tricks.as_strided(flat, (n, 2 * s.block, s.width), (s.block * flat.strides[0], *flat.strides))

            att = np.take(self.q, blocks[a:z], 0) @ window(self.k).transpose(0, 2, 1)
            att += self.bias
            att[nth[a:z] == 0, :, : s.block] = -np.inf  # there is no block before the first
            total = _exp_sum(att)
            o = att @ window(self.v)
            o /= total
            h = o.reshape(-1, s.width) @ self.out
            for of_class, at in zip(self.a, x, strict=True):
                h += np.take(of_class, at[some], 0)
            now, r = x[0][some], row[some]
            got[some] = self._log(np.maximum(h, 0) @ self.w["row"], np.take(self.prior.row, now, 0), r)
            h += np.take(self.w["given_row"], r, 0)
            got[some] += self._log(np.maximum(h, 0, out=h) @ self.w["col"], np.take(self.prior.col, now * s.side + r, 0), col[some])
        out = got / math.log(10) + self.classes.log_share[target]
        return out[place], out[begin + size - 1]

    @staticmethod
    def _log(logit: np.ndarray, prior: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithm of the softmax at a position of each row; logit is used up."""
        logit += prior
        wanted = np.take(_bound(logit).reshape(-1), _row_begins(*logit.shape) + at)
        np.exp(logit, out=logit)
        return wanted - np.log(logit @ np.ones((logit.shape[1], 1), logit.dtype))[:, 0]


#: The hash that stands for a text's end among words.
END_WORD = -1


#: Ids of a text, its end before and after: the vocabulary is below 65536.
LINE = "<u2"
#: Kinds of rows: a packet of a bucket's words, an id's count, the number of training texts, a training text, one held out.
#: A packet's word is its part of the hash space; its ids hold the sorted words' hashes, then their counts in training texts.
#: A text's word is its row in the bucket, n the number of its words that have no ids, ids its line, places the
#: numbers of its words among the bucket's sorted ones.
PACKET, ID, TRAINED, HELD, TEXTS = range(5)
_GATHERED = "kind int, bucket long, word long, n long, words long, ids binary, places binary"


def _packed(places: np.ndarray, distinct: int) -> np.ndarray:
    """A row of 3 bytes, or 4 where 3 do not do, for each place."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 3 if distinct < 1 << 24 else 4]


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if n:
        width = len(data) // n
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u4")[:, 0]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct numbers and each one's place among them; most repeat, so they are hashed before the few are sorted."""
    at, found = pd.factorize(x)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[at]


def _gather(path: str | None, s: Shape, parts: int = 1):
    """The rows of one bucket: a table of text, held_out and bucket."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        text, held = group.column("text").combine_chunks(), group.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
        own, total = hashed_words(path), np.zeros(s.vocabulary, np.int64)
        codes, number, bare, lines = [], [], [], []
        for i, j, buf, offsets in text_slices(text):
            w = hash_words(buf, offsets, lower=True)
            if b"<|" in buf.tobytes():  # special tokens keep their case
                ids, where, size = own.encode(hash_words(buf, offsets, lower=False))
            else:
                ids, where, size = own.encode(w)
            codes.append((w.hashes >> np.uint64(1)).astype(np.int64))
            number.append(np.diff(w.first))
            bare.append(np.bincount(np.repeat(np.arange(j - i), number[-1]), size == 0, minlength=j - i))
            total += np.bincount(ids[np.repeat(~held[i:j], np.diff(where))], minlength=s.vocabulary)
            line = np.full(len(ids) + 2 * (j - i), s.end, LINE)
            edge = where + 2 * np.arange(j - i + 1)
            line[np.arange(len(ids)) + np.repeat(edge[:-1] - where[:-1], np.diff(where)) + 1] = ids
            data, edge = line.tobytes(), (2 * edge).tolist()
            lines += [data[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)]
        total[s.end] += int((~held).sum())
        number = np.concatenate((*number, np.zeros(0, np.int64)))
        words, at = _distinct(np.concatenate((*codes, np.zeros(0, np.int64))))
        n = np.bincount(at, np.repeat(~held, number), minlength=len(words)).astype("<u4")
        cut = np.concatenate(([0], np.searchsorted(words, np.array([k * (1 << 63) // parts for k in range(1, parts)], np.int64)), [len(words)]))
        full = np.flatnonzero(np.diff(cut))
        places, first = _packed(at, len(words)), np.concatenate(([0], np.cumsum(number)))
        seen = np.flatnonzero(total)

        def rows(kind, word, n, words_=None, ids=None, places=None) -> pa.Table:
            size = len(word)
            none = pa.nulls(size, pa.binary())
            return pa.table({"kind": pa.array(np.broadcast_to(kind, size), pa.int32()), "bucket": pa.array(np.full(size, group.column("bucket")[0].as_py()), pa.int64()), "word": pa.array(word, pa.int64()), "n": pa.array(n, pa.int64()), "words": pa.array(words_ if words_ is not None else np.zeros(size, np.int64), pa.int64()), "ids": pa.array(ids, pa.binary()) if ids is not None else none, "places": pa.array(places, pa.binary()) if places is not None else none})

        return pa.concat_tables([
            rows(PACKET, full, np.diff(cut)[full], ids=[words[a:z].astype("<i8").tobytes() + n[a:z].tobytes() for a, z in zip(cut[full].tolist(), cut[full + 1].tolist(), strict=True)]),
            rows(ID, seen, total[seen]),
            rows(TEXTS, np.zeros(1, np.int64), np.array([(~held).sum()])),
            rows(np.where(held, HELD, TRAINED), np.arange(len(held)), np.concatenate((*bare, np.zeros(0))).astype(np.int64), number, lines, [places[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]),
        ])

    return run


def _buckets(path: str | None, s: Shape, parts: int):
    """Buckets of about bucket_bytes of text from a task's rows (doc_id, text, held_out)."""

    def run(batches):
        gather, some, held, bucket = _gather(path, s, parts), [], 0, TaskContext.get().partitionId() << 32

        def told() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(some)
            out = gather(group.append_column("bucket", pa.array(np.full(len(group), bucket), pa.int64())))
            texts = pc.is_in(out.column("kind"), pa.array([TRAINED, HELD], pa.int32()))
            at = pc.if_else(texts, out.column("word"), pa.scalar(None, pa.int64()))
            yield from out.append_column("doc_id", group.column("doc_id").combine_chunks().take(at.combine_chunks())).to_batches(1000)

        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                held += batch.column(1).nbytes
            if held >= s.bucket_bytes:
                yield from told()
                some, held, bucket = [], 0, bucket + 1
        if some:
            yield from told()

    return run


def _totals(group: pa.Table) -> pa.Table:
    """The words of one part, from all buckets: each packet's words' counts in all training texts."""
    data = [x.as_buffer() for x in group.column("ids").combine_chunks()]
    size = [x.size // 12 for x in data]
    words = np.concatenate([np.frombuffer(x, "<i8", k) for x, k in zip(data, size, strict=True)])
    counts = np.concatenate([np.frombuffer(x, "<u4", k, 8 * k) for x, k in zip(data, size, strict=True)])
    words, at = _distinct(words)
    total = np.bincount(at, counts, minlength=len(words)).astype(np.int64)
    out = total[at].astype("<u4" if total.max() < 1 << 32 else "<u8")
    edge = np.concatenate(([0], np.cumsum(size))).tolist()
    once = np.zeros(len(size), np.int64)
    once[0] = 1
    return pa.table({"bucket": group.column("bucket"), "part": group.column("word"), "n": pa.array(size, pa.int64()), "totals": pa.array([out[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), "tokens": once * total.sum(), "distinct": once * np.count_nonzero(total)})


def cut_windows(lines: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(windows x 2 * block + 1 ids, which of all but the first are the line's) of all lines; a window begins with the id that the one before it ends with."""
    ids, size, step = np.frombuffer(b"".join(lines), LINE), np.array([len(x) // 2 for x in lines], np.int64), 2 * s.block
    number = -(-(size - 1) // step)
    nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    at = (np.repeat(np.cumsum(size) - size, number) + nth * step)[:, None] + np.arange(step + 1)
    inside = at < np.repeat(np.cumsum(size), number)[:, None]
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)], np.uint16(s.end)), inside[:, 1:]


#: Windows that a task keeps to go over again, and bytes of lines that are cut at once.
KEPT, CUT_BYTES = 4096, 1 << 20


def _portions(batches, s: Shape) -> Iterator[list[bytes]]:
    """Lines of about CUT_BYTES; a longer line comes in pieces that begin with the id that the one before ends with."""
    some, held, step = [], 0, CUT_BYTES // (4 * s.block) * 4 * s.block
    for batch in batches:
        for line in batch.column(0).to_pylist():
            for a in range(0, len(line) - 2, step):
                some.append(line[a : a + step + 2])
                held += len(some[-1])
                if held >= CUT_BYTES:
                    yield some
                    some, held = [], 0
    if some:
        yield some


def _sums(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, part in enumerate(np.array_split(flat, _BLOCKS)):
        yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "block": pa.array([k], pa.int32()), "sums": [part.astype("<f8").tobytes()]})


_SUMS = "task int, block int, sums binary"


def _bigrams(classes: Classes, s: Shape):
    def run(batches):
        k, total = s.side**2, None
        for lines in _portions(batches, s):
            if total is None:
                total = np.zeros(k * k, np.int64)
            c = classes.of_id[np.frombuffer(b"".join(lines), LINE)]
            inside = np.ones(len(c), bool)
            inside[np.cumsum([len(x) // 2 for x in lines]) - 1] = False  # the last id has no next one
            inside = inside[:-1]
            total += np.bincount((c[:-1] * k + c[1:])[inside], minlength=k * k)
        if total is not None:
            yield from _sums(total)

    return run


def _train(weights: Weights, classes: Classes, prior: Prior, s: Shape, rate: float):
    def run(batches):
        forget_words()
        adam, seen, kept = Adam(weights, rate), 0, []

        def step(ids: np.ndarray, valid: np.ndarray) -> None:
            x = classes.of_id[ids]
            adam.step(loss_and_gradient(adam.w, np.ascontiguousarray(x[:, :-1]), np.ascontiguousarray(x[:, 1:]), valid.astype(np.float32), prior, False)[1])

        for lines in _portions(batches, s):
            ids, valid = cut_windows(lines, s)
            if seen < KEPT:
                kept.append((ids[: KEPT - seen].copy(), valid[: KEPT - seen].copy()))
            # neighbours of one text do not make a step of their own
            order = np.random.Generator(np.random.PCG64(seen)).permutation(len(ids))
            for a in range(0, len(order), s.batch):
                step(ids[order[a : a + s.batch]], valid[order[a : a + s.batch]])
            seen += len(ids)
        if kept:
            rng = np.random.Generator(np.random.PCG64(seen))
            ids, valid = (np.concatenate(x) for x in zip(*kept, strict=True))
            while adam.t < s.least_steps:
                some = rng.integers(0, len(ids), s.batch)
                step(ids[some], valid[some])
            yield from _sums(np.append(pack_weights(adam.w).astype(float), 1.0) * seen)

    return run


def train(lines: DataFrame, counts: np.ndarray, s: Shape) -> tuple[Weights, Classes, Prior]:
    """The model of lines (bucket, word, ids), given the counts of ids."""
    k, classes = s.side**2, make_classes(counts, s)
    parts = tree_sum(lines.select("ids").mapInArrow(_bigrams(classes, s), _SUMS))
    classes, prior = arrange(classes, np.concatenate(parts).reshape(k, k) if parts else np.zeros((k, k)), s)
    weights = first_weights(s)
    for r in range(s.rounds):
        own = lines.where(F.pmod(F.xxhash64("bucket", "word"), F.lit(s.rounds)) == r).select("ids")
        parts = tree_sum(own.mapInArrow(_train(weights, classes, prior, s, s.rate / (1 + r)), _SUMS))
        if parts:
            flat = np.concatenate(parts)
            weights = unpack_weights(flat[:-1] / flat[-1], weights)
    return weights, classes, prior


def _score(model: tuple[Weights, Classes, Prior], s: Shape, bare: float):
    """(bucket, word, score) of rows (bucket, word, n, ids); bare: log10 of the share of a word without ids."""

    def run(batches):
        forget_words()
        scorer = Scorer(*model, s)
        for batch in batches:
            line, n = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            size = np.array([len(x) // 2 - 2 for x in line], np.int64)
            score = [np.zeros(0)]
            # about as many ids at once as a slice of text has
            group = np.cumsum(size) // (CUT_BYTES // 2)
            for some in np.split(np.arange(len(line)), np.flatnonzero(np.diff(group)) + 1) if len(line) else ():
                where = np.concatenate(([0], np.cumsum(size[some])))
                of_id, of_end = scorer.log10(np.frombuffer(b"".join(line[k][2:-2] for k in some), LINE), where)
                score.append(np.diff(np.concatenate(([0.0], np.cumsum(of_id)))[where]) + of_end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(score) + n * bare)], ["bucket", "word", "score"])

    return run


_BASE = "doc_id {}, bucket long, word long, held_out boolean, n_tokens long, n_known long, base_score double"


def _base(train_tokens: int, distinct: int, texts: int):
    """The counts and the base score of a bucket's texts; told: the totals of its words."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("part").combine_chunks()
        totals = np.concatenate((np.zeros(0, np.int64), *(np.frombuffer(x, "<u4" if len(x) == 4 * n else "<u8") for x, n in zip(told.column("totals").to_pylist(), told.column("n").to_pylist(), strict=True))))
        floor = math.log10(train_tokens + 0.1 * (distinct + 1))
        log, known = np.log10(totals + 0.1) - floor, totals > 0
        number = docs.column("words").to_numpy()
        places = [_unpacked(x, n) for x, n in zip(docs.column("places").to_pylist(), number.tolist(), strict=True)]
        return pa.table({
            "doc_id": docs.column("doc_id"), "bucket": docs.column("bucket"), "word": docs.column("word"), "held_out": np.equal(docs.column("kind").to_numpy(), HELD), "n_tokens": number + 1,
            "n_known": np.array([int(known[x].sum()) for x in places], np.int64) + int(texts > 0), "base_score": np.array([log[x].sum() for x in places]) + math.log10(texts + 0.1) - floor,
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A null, empty or blank text is its end alone.  A null id counts as the empty string in
    held_out.  Repeated rows count and score each by itself; other columns are
    ignored; no rows give no rows; where every id is held out all counts are 0 and the
    model is the untrained one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(shape.fold)) == 0
    parts = max(1, -(-total // (4 * shape.bucket_bytes)))
    gathered = materialize(rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(_buckets(tokenizer_path, shape, parts), f"{_GATHERED}, doc_id {kind}"), "gathered", "kind")
    packets = gathered.where(F.col("kind") == PACKET).select("bucket", "word", "ids")
    totals = materialize(packets.groupBy("word").applyInArrow(_totals, "bucket long, part long, n long, totals binary, tokens long, distinct long"), "totals")
    discard(gathered, part=f"kind={PACKET}")
    tokens, distinct = (x or 0 for x in totals.agg(F.sum("tokens"), F.sum("distinct")).first())
    texts = gathered.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    train_tokens, distinct = tokens + texts, distinct + int(texts > 0)
    counts = np.zeros(shape.vocabulary)
    for r in gathered.where(F.col("kind") == ID).groupBy("word").agg(F.sum("n").alias("n")).collect():  # vocabulary rows at most
        counts[r["word"]] = r["n"]
    model = train(gathered.where(F.col("kind") == TRAINED).select("bucket", "word", "ids"), counts, shape)
    own = gathered.where(F.col("kind").isin(TRAINED, HELD))
    base = own.select("doc_id", "bucket", "word", "kind", "words", "places").groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(_base(train_tokens, distinct, texts), _BASE.format(kind))
    bare = math.log10(0.1) - math.log10(train_tokens + 0.1 * (distinct + 1))  # of a word that training has not seen
    scores = own.select("bucket", "word", "n", "ids").mapInArrow(_score(model, shape, bare), "bucket long, word long, score double")
    return base.join(scores, ["bucket", "word"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every whole document, with counts and training from the documents that are not held out."""
    return score_texts(table(spark, sf_dir, "documents"))
