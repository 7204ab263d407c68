"""Each operator on small rows: nulls, empty texts, repeated rows, clashing columns, empty tables, and a plain version of it."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, language_model, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secrets, sharding, warc
from tessera.llm.shared import hash_words, new_path, text_slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu") for c in ("n", "x", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 80)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 45):  # near copies, some of them chained
        words = rows[i - 30][1].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(45, base[0]), (45, base[0]), (45, base[3] + " more"), (46, None), (47, ""), (48, " \n\t "), (49, "two words"), (50, "Two WORDS"), (None, base[1]), (51, sentence(rng, 9000)), (52, "ß ﬁ 中文 \x85🙂 words")]
    return [(i, t, "en", "s", 0) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_follow_words():
    texts = [t or "" for _, t, *_ in corpus()]
    known = {}
    for limit in (64, 1 << 20):
        for i, j, buf, offsets in text_slices(pa.array(texts), limit):
            w = hash_words(buf, offsets, lower=True)
            for k in range(j - i):
                words = texts[i + k].encode().lower().split()
                got = w.hashes[w.first[k] : w.first[k + 1]].tolist()
                assert len(got) == len(words)
                assert all(known.setdefault(x, h) == h for x, h in zip(words, got, strict=True))
    assert len(set(known.values())) == len(known)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_ngram_join(docs, empty):
    rows = [(i, shingles(t)) for i, t, *_ in corpus()]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[part[k]] = min(low.get(part[k], i), i)
    want = sorted((str(i), len(s), str(low.get(part[k], i))) for k, (i, s) in enumerate(rows))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.ngram_jaccard_join(docs).collect()) == want
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_parts_lose_no_link():
    from fractions import Fraction

    rng, none = np.random.default_rng(2), np.zeros(ngram_join.SKETCH, bool)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut = int(rng.integers(0, len(x) // 9 + 1))
        y = np.unique(np.concatenate((x[cut:], rng.integers(0, 2**63, cut).astype(np.uint64))))
        if 10 * ngram_join.overlap_of(x, y) >= 8 * len(np.union1d(x, y)):
            assert set(ngram_join.part_keys(x, Fraction("0.8"), none)) & set(ngram_join.part_keys(y, Fraction("0.8"), none))


def test_decontaminate(spark, docs, empty):
    rng = random.Random(9)
    sentence = lambda rng, n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [sentence(rng, 25) + f" answer{i} final{i}" for i in range(12)]
    marked = items[1].replace(" ", ", ").upper()
    words = items[2].split()
    words[3], words[11] = "another", "word"
    leaks = [(100 + i, sentence(rng, 70) + " " + t + " " + sentence(rng, 50)) for i, t in enumerate((items[0], marked, " ".join(words)))]
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    other = [(200 + i, sentence(rng, 100)) for i in range(60)]
    more = docs.union(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in leaks + other], SCHEMA))
    assert {(r[0], r[1]) for r in decontaminate.find_contamination(more, benchmark).collect()} == {(100, 0), (101, 1), (102, 2)}
    assert decontaminate.drop_contaminated(more, benchmark).count() == docs.count() + 60
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).count() == 0


def test_space_is_fitted_on_every_passage(spark):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randint(1, 150)) for _ in range(40)]
    s = decontaminate.Settings(terms=256, rank=8, drop=2, oversampling=6)
    rows = []
    for t in texts:
        data = t.encode()
        h = (decontaminate.plain_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes >> np.uint64(17)).astype(np.int64) % s.terms
        rows += [np.bincount(h[k : k + 2 * s.block], minlength=s.terms) for k in range(0, len(h), 2 * s.block)]
    a = np.array(rows, float)
    idf = np.log((1 + len(a)) / (1 + (a > 0).sum(0))) + 1
    a = a * idf / np.sqrt((a * idf**2).sum(1))[:, None]
    omega = np.random.Generator(np.random.PCG64(7)).standard_normal((s.terms, s.rank + s.drop + s.oversampling))
    z = a.T @ (a @ omega)
    values, vectors = np.linalg.eigh(omega.T @ z)
    u, sigma, _ = np.linalg.svd(z @ (vectors / np.sqrt(values)), full_matrices=False)
    want = idf[:, None] * u[:, s.drop : s.drop + s.rank] / sigma[s.drop : s.drop + s.rank]
    got = decontaminate.fit_space(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), s=s).weights
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = {}
        for j, y in enumerate(b):
            places[y] = places.get(y, 0) | 1 << j
        assert decontaminate.common_subsequence(a, places, len(b)) == table[-1][-1]


def test_language_model(docs, empty):
    shape = language_model.Shape(side=6, shared=6, least_steps=5, bucket_bytes=20_000)
    rows = language_model.score_texts(docs, shape=shape).collect()
    texts = [(i, (t or "").encode().lower().split()) for i, t, *_ in corpus()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in texts if not held(i) for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t, None]), 6)) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) for r in rows)
    assert language_model.score_texts(empty, shape=shape).count() == 0


def test_training_reads_every_subword():
    pytest.importorskip("public_tokenizers")
    rng, s = random.Random(2), language_model.Shape()
    texts = [sentence(rng, n) for n in (0, 1, 40, 3000)]
    got = language_model._gather(None, s)(pa.table({"text": texts, "held_out": [False] * 4, "bucket": pa.array([0] * 4, pa.int32())})).to_pylist()
    lines, counts = [r["ids"] for r in got if r["kind"] == 2], {r["word"]: r["n"] for r in got if r["kind"] == 1}
    assert sum(map(len, lines)) >= 2 * sum(counts.values())
    ids, valid = language_model.cut_windows(lines, s)
    assert Counter(ids[:, 1:][valid].tolist()) == counts
    assert ids.shape[1] == 2 * s.block + 1 and (ids[~np.pad(valid, ((0, 0), (1, 0)), constant_values=True)] == s.end).all()


def test_gradient():
    s = language_model.Shape(side=3, shared=2, width=4, hidden=5, block=4, vocabulary=50, end=49)
    rng = np.random.default_rng(0)
    w = {k: x + rng.standard_normal(x.shape) * 0.1 for k, x in language_model.first_weights(s).items()}
    x, y, valid = rng.integers(0, 9, (3, 8)), rng.integers(0, 9, (3, 8)), np.ones((3, 8))
    valid[1, 5:] = 0
    gradient = language_model.loss_and_gradient(w, x, y, valid)[1]
    for k in w:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in w[k].shape)
            w[k][i] += 1e-4
            up = language_model.loss_and_gradient(w, x, y, valid)[0]
            w[k][i] -= 2e-4
            down = language_model.loss_and_gradient(w, x, y, valid)[0]
            w[k][i] += 1e-4
            assert abs((up - down) / 2e-4 - gradient[k][i]) < 1e-5


def test_sharding(spark, docs, empty, tmp_path):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    sizes = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sizes
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered] == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    sharding.write_shards(docs.withColumnRenamed("source", "slot"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice(string.printable) for _ in range(n))
    same = noise(1500)
    rows = [(i, f"http://x/{i}", noise(rng.randint(0, 3000))) for i in range(60)] + [(60, "http://a b\n", same), (61, None, same), (62, "u", same), (63, "u", "short"), (64, "u", "short"), (65, "u", None), (66, "u", ""), (67, "u", "é中" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, new_path(spark, "warc"))
    want = {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == same and i < 62 else "response", 62 if h == same and i < 62 else None) for i, _, h in rows}
    for split in (97, 1000, 1 << 22):
        got = warc.read_warc(manifest, split).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
        assert len(got) == len(rows)
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_path(spark, "warc"))).count() == 0


def test_quality_rules(spark, docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = {(str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(docs.union(spark.createDataFrame([(200, "a b\n\na b\n \na b\nc # |", None, "s", 0), (201, "one two three four five six seven eight nine " * 3, "en", "s", 0)], SCHEMA))).collect()}
    want = set()
    for i, t in [*((i, t) for i, t, *_ in corpus()), (200, "a b\n\na b\n \na b\nc # |"), (201, "one two three four five six seven eight nine " * 3)]:
        t = t or ""
        w, seen, dup = word.findall(t), set(), 0
        for line in t.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        held = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        want.add((str(i), len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(held), len(w) < 20 or 100 * len(held) > 30 * len(w)))
    assert rows == want
    assert quality_rules.drop_low_quality(docs).columns == docs.columns
    assert quality_rules.quality_rules(empty).count() == 0


def test_a_rare_language_is_not_held_against_others(spark):
    rng = random.Random(31)
    rare = " ".join("ÑÜÇ" + rng.choice(WORDS).upper() + "!" for _ in range(120))
    rows = [(i, sentence(rng, 80), "en") for i in range(300)] + [(300, rare, "xx"), (301, rare, None), (302, rare, "en"), (303, "too short", "yy")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(table).where("kept").collect()}
    assert kept & {300, 301, 302, 303} == {300, 301}
    assert {r["doc_id"] for r in quality_rules.drop_low_quality(table).collect()} == kept


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 60) if i % 2 else " ".join(w + rng.choice(("###", "$$$")) for w in sentence(rng, 60).split())) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit_quality(table, labels)
    got = quality_classifier.score_quality(table, model).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_quality(docs, model).collect())
    assert quality_classifier.score_quality(empty, quality_classifier.fit_quality(empty, labels.limit(0))).count() == 0


def test_line_dedup(spark, docs, empty):
    header, user = "All rights are reserved by this site", "page {} was served to reader {} on port 80"
    rows = [(i, f"{header}\nown line number of {sentence(random.Random(i), 6)}\n{user.format(i * 7, i * 13)}\n\nshort") for i in range(8)]
    named = [(20 + i, f"signed in the name of the team by {x}") for i, x in enumerate(("anna", "bert", "cora", "dirk", "emil", "fred"))]
    table = spark.createDataFrame([*rows, *named, (40, None), (41, "")], "doc_id long, text string").withColumn("n_dropped", pytest.importorskip("pyspark.sql.functions").lit(9))
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(table).collect()}
    assert got[0] == (rows[0][1], 0) and got[40] == (None, 0) and got[41] == ("", 0)
    assert all(got[i] == ("\n".join([rows[i][1].split("\n")[1], "", "short"]), 2) for i in range(1, 8))
    assert got[20][1] == 0 and all(got[20 + i] == ("", 1) for i in range(1, 6))  # a word is a variable field too
    assert sorted(str(r) for r in line_dedup.dedup_lines(docs).drop("n_dropped").collect()) == sorted(str(r) for r in docs.collect())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_long_lines_go_from_the_second_text_on(spark):
    rng = random.Random(21)
    shared, numbers, short = sentence(rng, 50), " ".join(str(k) for k in range(50)), sentence(rng, 49)
    own = [sentence(rng, 60) for _ in range(6)]
    texts = {1: [own[0], shared], 2: [shared, own[1], shared], 3: [own[2], numbers, short], 4: [numbers, own[3], short], 5: [own[4], shared + " more"], 6: [own[5]], 7: [own[5]]}
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()}
    want = {**texts, 2: [own[1]], 4: [own[3], short]}
    assert got == {i: ("\n".join(t), len(texts[i]) - len(t)) for i, t in want.items()}


def test_packing(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path(packing.TOKENIZER))
    rows = packing.pack_best_fit(docs, tokens=256, documents=5, cost=50_000.0).collect()
    ids = Counter((str(i), tuple(own.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in corpus())
    by_doc: dict = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        by_doc.setdefault(str(r["doc_id"]), []).append(r)
    assert sum(r["length"] for r in rows) == sum(len(x) * n for (_, x), n in ids.items())
    for (i, x), n in ids.items():
        if n == 1 and sum(k[0] == i for k in ids) == 1:
            assert b"".join(bytes(r["ids"]) for r in by_doc[i]) == np.array(x, "<u4").tobytes()
    for s in {r["sequence_id"] for r in rows}:
        held = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 256 and len(held) <= 5 and (len(held) == 1 or sum(n * n for _, n in held) <= 50_000)
    assert packing.pack_best_fit(empty).count() == 0
    assert packing.pack_best_fit(docs, rule="dot").count() >= docs.count()


def test_word_ids_equal_text_ids():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(public.path(packing.TOKENIZER)), random.Random(3)
    letters = "ab Z9'sStT.,!-_é́ñ  \x1c\x85\x0b\t\n<|>İΣς ﬁ中🙂'll're\"(0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a <|endoftext|> b", "x<|startoftext|>y, z"]
    words = packing.WordTokenizer(public.path(packing.TOKENIZER))
    for i, j, buf, offsets in text_slices(pa.array(texts), 4096):
        ids, first, _ = words.encode(packing.split_marks(buf, offsets)[0])
        for k in range(j - i):
            assert ids[first[k] : first[k + 1]].tolist() == own.encode(texts[i + k], add_special_tokens=False).ids


def test_secrets(spark, docs, empty):
    rng = random.Random(8)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48))
    text = f'é Password = "abcdefgh1" token: short AKIA{"A1" * 8} {"0f" * 20} see {key} and identifier_of_2_parts_and_words_2024'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(rows).collect()}
    spans = [(text[s["start"] : s["end"]], secrets.KINDS[s["kind"]]) for s in got[1]["spans"]]
    assert spans == [('Password = "abcdefgh1', "assign"), ("AKIA" + "A1" * 8, "access"), ("0f" * 20, "hex"), (key, "random")]
    assert got[2]["spans"] == [] and got[3]["base"] == []
    assert secrets.scan_secrets(empty).count() == 0


def test_values_after_a_name_are_tested(spark):
    rng = random.Random(18)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48)) for _ in range(3)]
    text = f"SESSION_KEY={keys[0]} sig={keys[1]}== {keys[2]}= a_name_of_20_letters_or_more=1"
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == [keys[0], keys[1] + "==", keys[2] + "="]
    assert got["base"] == []


def test_battery_keeps_its_level():
    rng = random.Random(1)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"):
        p = [secrets.battery("".join(rng.choice(alphabet) for _ in range(48)))[1] for _ in range(400)]
        assert sum(x < 0.01 for x in p) <= 16
    assert secrets.battery("a1" * 24)[1] < 1e-6
