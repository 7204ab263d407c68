"""Operators 11 to 13 against plain versions, on the smallest tables and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import online_packing, source_divergence, whitening
from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.shared import text_buffer

DIR = "/root/testdata/sf0.001"
OWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, DOC_ID_ string, ids string, Term string"


def rows_of(name, at=DIR):
    return pq.read_table(f"{at}/{name}.parquet").to_pylist()


def ids_of(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(("One", "word", "Ärger", "ÉTÉ", "naïve", "x2y", "don't", "ＡＢ")) + rng.choice((".", "", "!", "-", "_")) + rng.choice((" ", "  ", "\n", "\t ", "\xa0", " \x85", "\x1c", "　 "))
    rows = [(i, "".join(word() for _ in range(rng.randrange(1, 900))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "", None))) for i in range(120)]
    rows += [rows[0], rows[0], (200, None, None, None), (201, "", "en", "c"), (202, " \n\t\n ", "en", "d"), (None, "a b a <|endoftext|> c", "en", "a"), (203, "".join(word() for _ in range(40_000)), "en", "a"), (204, "x" * 5000, "xx", "lonely")]
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


# --- 11 -----------------------------------------------------------------------------------------


def check_packing(texts, rows, window=1024):
    """texts: a list of (doc_id, text); every id once, sequences gapless and full or of a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for k, t in texts:
        want[k].append(ids_of(t))
    assert pieces.keys() == want.keys()
    for k, all_ids in want.items():
        at = defaultdict(list)
        for r in pieces[k]:
            at[r["doc_tokens"], r["start"]].append(r)
        found = Counter()
        for (tokens, start), same in at.items():
            ids = next(i for i in all_ids if len(i) == tokens)
            for r in same:
                part = ids[start : start + r["length"]]
                crc = zlib.crc32(np.array(part, "<u4").tobytes())
                assert len(part) == r["length"] and (len({tuple(i) for i in all_ids if len(i) == tokens}) > 1 or crc == r["ids_crc32"])
                found[tokens] += r["length"]
        assert found == {n: n * c for n, c in Counter(map(len, all_ids)).items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_op11(spark):
    rows = QUERIES["op11_online_packing"](spark, DIR).collect()
    check_packing([(r["doc_id"], r["text"]) for r in rows_of("documents")], rows)


def test_op11_odd_rows(spark, odd):
    got = online_packing.pack_online(odd.repartition(3)).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], got)
    assert online_packing.pack_online(odd.limit(0)).count() == 0


def test_units_are_the_tokenizers():
    rng = random.Random(8)
    signs = "ab1 \n\t.'-_\r\x0b\x0c\x1c\x1f\x85\xa0  　é漢😀"
    import pyarrow as pa

    own = online_packing.hashed_words(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", " ", "a", " a ", "<|endoftext|>", "a  <|endoftext|>  b"]
    buf, offsets = text_buffer(pa.array(texts))
    ids, first, _ = own.encode(online_packing.text_units(buf, offsets))
    plain = [e.ids for e in OWN.encode_batch(texts, add_special_tokens=False)]
    assert [ids[first[k] : first[k + 1]].tolist() for k in range(len(texts))] == plain


def test_levels_choose_the_smallest_sum_of_squares():
    rng, size = random.Random(5), 12
    levels, counts, seen = online_packing.Levels(size), [0] * (size + 1), 0
    for k in range(3000):
        length = rng.choice((3, 4, 5, 6, 7, 8, 9, 12))  # of which each has its counterpart
        options = {}
        for h in range(size - length + 1):
            if h == 0 or counts[h]:
                after = counts.copy()
                after[h] -= h > 0
                after[h + length] += h + length < size
                options[h] = sum(c * c for c in after)
        best = max(h for h, v in options.items() if v == min(options.values()))
        assert levels.choose(length) == best
        levels.add(online_packing.Piece(k, 0, np.full(length, k, np.uint32), length))
        counts[best] -= best > 0
        counts[best + length] += best + length < size
        assert counts[1:size] == levels.count[1:size].tolist()
        seen += length
    full = Counter()
    for p, s, _ in levels.rows:
        full[s] += len(p.ids)
    assert set(full.values()) == {size}
    assert seen - sum(full.values()) == levels.tokens < 0.05 * seen  # few windows are left open
    levels.fill_up(last=True)
    ends = Counter()
    for p, s, _ in levels.rows:
        ends[s] += len(p.ids)
    assert sum(ends.values()) == seen and all(n == size or n & (n - 1) == 0 for n in ends.values()) and sum(n < size for n in ends.values()) <= 4


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(online_packing, "OPEN_TOKENS", 5000)
    levels = online_packing.Levels(1024)
    for k in range(500):  # over half a window each: no two fit
        levels.add_document(k, np.full(600, k, np.uint32))
        assert levels.tokens <= 5000
    levels.fill_up(last=True)
    assert sum(len(p.ids) for p, _, _ in levels.rows) == 300_000


# --- 12 -----------------------------------------------------------------------------------------


def compare(spark, df, sql, at):
    got = sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))
    want = sorted(duckdb.sql(sql.replace("FROM documents", f"FROM '{at}'")).fetchall())
    assert got == want


def test_op12(spark):
    compare(spark, QUERIES["op12_source_divergence"](spark, DIR), ORACLE["op12_source_divergence"], f"{DIR}/documents.parquet")


def test_op12_odd_rows(spark, odd, tmp_path):
    odd.coalesce(1).write.parquet(str(tmp_path / "odd"))
    df = source_divergence.source_divergence(odd)
    compare(spark, df, ORACLE["op12_source_divergence"], f"{tmp_path}/odd/*.parquet")
    assert not df.where("lang = 'xx'").count()  # one source, and no term in three documents
    assert df.where("lang = 'en' AND source = 'd' AND part = 'pair'").count() == df.where("lang = 'en'").select("source").distinct().count() - 1
    assert source_divergence.source_divergence(odd.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a b c", "en", "a"), (2, None, "en", "b")], "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in source_divergence.source_divergence(nothing).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_of_very_large_counts(spark):
    for n, mass in ((0, 1), (7, 8), (123_456_789_012, 987_654_321_098_765), (10**15, 9 * 10**15), (998, 999)):
        got = spark.range(1).select(F.expr(source_divergence._share(f"{n}L", f"{mass}L"))).first()[0]
        assert got == 1 + 10**9 * (n + 1) // mass


# --- 13 -----------------------------------------------------------------------------------------


def check_whitening(vectors, rows, columns=16):
    """vectors: (vec_id, entries) that remain."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s).astype(float) / n
    cov = centred.T @ centred / n
    e = np.linalg.eigh(cov)[0][::-1]
    k = min(columns, int((e > 1e-10 * e[0]).sum()))
    by = defaultdict(list)
    for r in rows:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, k + 1))
    deviation = Counter((i, int(((n * r - s) ** 2).sum())) for (i, _), r in zip(vectors, x, strict=True))
    assert all(Counter((r["vec_id"], r["deviation"]) for r in by[c]) == deviation for c in by)
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-9
    place = {i: k for k, (i, _) in enumerate(vectors)}
    w = np.zeros((len(place), k))
    for r in rows:
        w[place[r["vec_id"]] if len(place) == len(vectors) else 0, r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) <= 1e-9
    if len(place) == len(vectors) == n:
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
        z = (n * x - s).astype(float) / n
        for c in range(k):  # whitened times the root of e is a projection on a unit eigenvector
            u = cov @ (z.T @ w[:, c] / n / np.sqrt(e[c])) / e[c]
            assert abs(np.linalg.norm(u) - 1) < 1e-6 and np.abs(z @ u / np.sqrt(e[c]) - w[:, c]).max() < 1e-6


def test_op13(spark):
    rows = QUERIES["op13_whitening"](spark, DIR).collect()
    check_whitening([(r["vec_id"], r["embedding"]) for r in rows_of("embeddings")], rows)


def test_op13_odd_rows(spark):
    rng, inf = np.random.default_rng(4), float("inf")
    good = [(i, [float(c) for c in rng.normal(5, 300, 40)], 0, "x") for i in range(90)]
    bad = [(100, None, 1, "x"), (101, [None] * 40, 1, "x"), (102, [inf] + [0.0] * 39, 1, "x"), (103, [float("nan")] * 40, 1, "x"), (104, [1.0], 1, "x"), (105, [], 1, "x"), (106, [1e300] * 40, 1, "x")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int, Component string").repartition(5)
    check_whitening([r[:2] for r in good], whitening.whiten(df).collect())
    twice = df.union(df)
    got = whitening.whiten(twice).collect()
    assert len(got) == 2 * 90 * 16 and {r["n"] for r in got} == {90}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0  # one vector has no direction
    few = df.where("vec_id < 5")  # of rank four
    check_whitening([r[:2] for r in good[:5]], whitening.whiten(few).collect())
    far = spark.createDataFrame([(i, [c * 1e9 for c in v]) for i, v, *_ in good], "vec_id long, embedding array<double>")  # products beyond 2**53
    assert {r["n"] for r in whitening.whiten(far).collect()} == {90} and whitening.whiten(far).first()["identity_error"] < 1e-9


def test_op13_counts_no_vector_twice_over_tasks(spark):
    rng = np.random.default_rng(9)
    base = [(i, [float(c) for c in rng.normal(0, 1, 70)]) for i in range(60)]
    df = spark.createDataFrame(base + [(i + 1000, base[0][1]) for i in range(200)], "vec_id long, embedding array<double>").repartition(9)
    rows = whitening.whiten(df).collect()
    assert {r["n"] for r in rows} == {60} and rows[0]["identity_error"] < 1e-9
    hot = [r["whitened"] for r in rows if r["component"] == 1 and r["vec_id"] >= 1000]
    assert len(hot) == 200 and max(hot) - min(hot) < 1e-12
