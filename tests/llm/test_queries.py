"""Every opN_ query on the smallest tables: its contract columns against plain versions."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard

from tessera.llm import decontaminate, language_model, packing, quality_classifier, secrets
from tessera.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(at=DIR):
    return pq.read_table(f"{at}/documents.parquet").to_pylist()


def answer(spark, name, at=DIR):
    return QUERIES[name](spark, at).collect()


def plain_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def check_secrets(rows, texts):
    names = ("assign", "access", "hex")
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_op10(spark):
    at = "/root/testdata/sf0.01"  # the smallest table has no secrets
    texts = {r["doc_id"]: r["text"] for r in documents(at)}
    rows = answer(spark, "op10_secrets", at)
    check_secrets(rows, texts)
    assert len(rows) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows)


def test_op10_finds_planted_tokens(spark, tmp_path):
    rng = random.Random(41)
    symbols = string.ascii_letters + string.digits
    texts, planted = {}, set()
    for i in range(400):
        words = [rng.choice(("some", "plain", "words", "that", "nobody", "would", "hide")) for _ in range(40)]
        words[7] = secrets.decoy(rng.sample(secrets._PLAIN_WORDS, 10), rng.choice(("base62", "base64", "base64url")), rng.randint(24, 60), rng.randrange(9999))
        if i % 4 == 0:
            words[20] = "".join(rng.choice(symbols) for _ in range(rng.choice((36, 40, 48))))
            if any(map(str.isdigit, words[20])):
                planted.add((i, words[20]))
        if i % 50 == 0:
            words[30] = f"password: {'x' * 9} AKIA{'A1' * 8} {'0f' * 20}"
        texts[i] = " ".join(words)
    texts[400], texts[401], texts[402] = None, "", " ".join(rng.choice(("a", "long", "text")) for _ in range(60_000)) + " secret=abcdefgh12"
    rows = [(i, t, "en") for i, t in texts.items()] + [(0, texts[0], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_secrets"](spark, str(tmp_path)).collect()
    check_secrets(got, texts)
    assert len(got) == len(rows)
    found = {(r["doc_id"], texts[r["doc_id"]][int(a) : int(b)]) for r in got for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind == "random"}
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.1 * len(found)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_op1(spark):
    sets = {r["doc_id"]: shingles(r["text"]) for r in documents()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                low[max(root(a), root(b))] = min(root(a), root(b))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in answer(spark, "op1_ngram_join")} == {(i, len(s), root(i)) for i, s in sets.items()}


def test_op2_finds_all_that_hold_an_item_word_for_word(spark):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()
    want = {(r["doc_id"], b["item_id"]) for r in documents() for b in items if len(plain(b["text"]).split()) >= 6 and plain(b["text"]) in plain(r["text"])}
    assert want <= {(r["doc_id"], r["item_id"]) for r in answer(spark, "op2_decontaminate")}


def test_op2_finds_paraphrases(spark):
    """Items with a share of their words replaced, the answer left whole, inside other texts."""
    rng = random.Random(77)
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist() if len(r["text"].split()) >= 16]
    texts = [r["text"] for r in documents("/root/testdata/sf0.01") if r["lang"] == "en" and 100 <= len((r["text"] or "").split()) <= 400]
    words = [w for t in texts[:50] for w in t.split()]
    rows, planted = [(i, t) for i, t in enumerate(texts)], defaultdict(set)
    for share in (0.1, 0.2, 0.3, 0.4):
        for item, text in items:
            w = text.split()
            for k in rng.sample(range(len(w) - 6), int(share * len(w))):
                w[k] = rng.choice(words)
            host = rng.choice(texts).split()
            cut = rng.randrange(len(host))
            rows.append((10_000 + len(rows), " ".join(host[:cut] + w + host[cut:])))
            planted[share].add((rows[-1][0], item))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {share: len(found & p) / len(p) for share, p in planted.items()}
    assert all(r >= 0.9 for r in recall.values()), recall


def test_capitals_of_two_bytes():
    text = "ΑΩ ΔΟΛΟ ПРИВЕТ ЁЖ ÉCOLE ÀÞ×÷ plain ÿ"
    data = text.encode()
    assert decontaminate.plain_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).buf.tobytes().decode() == text.lower()


def test_op3(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in documents()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    rows = answer(spark, "op3_lm_scoring")
    assert len(rows) == len(texts)
    for r in rows:
        t = [*texts[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(counts[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
        assert r["score"] < 0


def plain_log10(w, classes, prior, s, ids):
    """log10 of each id and of the end, by a loop over places in double precision, and the shares of all ids at the last place."""
    x = [classes.of_id[s.end], *classes.of_id[ids]]
    y = [*ids, s.end]
    out = []
    for t in range(len(x)):
        first = (t // s.block - 1) * s.block
        seen = range(max(0, first), t + 1)
        e = w["e"].astype(float)
        score = np.array([e[x[t]] @ w["q"] @ (e[x[j]] @ w["k"]) / math.sqrt(s.width) + w["far"][t - j] for j in seen])
        att = np.exp(score - score.max())
        o = (att / att.sum()) @ np.array([e[x[j]] @ w["v"] for j in seen])
        h = np.concatenate((e[x[t]], e[x[t - 1]] if t else np.zeros(s.width), o)) @ w["a"] + w["c"]
        share = np.zeros(s.side**2)
        row = np.exp(np.maximum(h, 0) @ w["row"] + prior.row[x[t]])
        for r in range(s.side):
            col = np.exp(np.maximum(h + w["given_row"][r], 0) @ w["col"] + prior.col[x[t] * s.side + r])
            share[r * s.side : (r + 1) * s.side] = row[r] / row.sum() * col / col.sum()
        every = share[classes.of_id] * 10**classes.log_share
        out.append(math.log10(every[y[t]]))
    return out, every


def test_scores_equal_a_plain_loop_and_shares_sum_to_one():
    s = language_model.Shape(side=4, shared=3, width=4, hidden=5, block=4, vocabulary=40, end=39)
    rng = np.random.default_rng(3)
    classes, prior = language_model.arrange(language_model.make_classes(rng.integers(0, 50, 40).astype(float), s), rng.integers(0, 9, (16, 16)).astype(float), s)
    w = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32) for k, x in language_model.first_weights(s).items()}
    texts = [rng.integers(0, 39, n) for n in (0, 1, 3, 4, 5, 23, 900)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    of_id, of_end = language_model.Scorer(w, classes, prior, s).log10(np.concatenate(texts), first)
    for k, t in enumerate(texts):
        want, shares = plain_log10(w, classes, prior, s, t)
        assert np.allclose([*of_id[first[k] : first[k + 1]], of_end[k]], want, atol=1e-4)
        assert abs(shares.sum() - 1) < 1e-6


def test_op3_model_beats_the_word_counts(spark):
    rows = [r for r in answer(spark, "op3_lm_scoring", "/root/testdata/sf0.01") if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_op4(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents()}
    rows = answer(spark, "op4_sharding")
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {(i, len(t) + 1, zlib.crc32(t), "bytes", None) for i, t in texts.items()}
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    mean, largest = sum(held.values()) / 8, max(r["size"] for r in rows)
    assert set(held) == set(range(8)) and all(abs(x - mean) <= largest for x in held.values())
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_op5(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(f"{DIR}/pages.parquet").to_pylist()}
    last = {}
    for i, p in sorted(pages.items()):
        last[p] = i
    want = {(i, len(p), hashlib.sha1(p).hexdigest(), *(("response", None) if len(p) < 1000 or last[p] == i else ("revisit", last[p]))) for i, p in pages.items()}
    assert {tuple(r)[:5] for r in answer(spark, "op5_warc")} == want


def test_op6(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents()}
    rows = answer(spark, "op6_quality_rules")
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again), failed)
        assert not (failed and r["kept"])


def test_op7(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model, texts = quality_classifier.fit_quality(docs, labels), {r["doc_id"]: (r["text"] or "").encode() for r in documents()}
    rows = answer(spark, "op7_quality_classifier")
    assert len(rows) == len(texts)
    for r in rows:
        size = [len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress(texts[r["doc_id"]])) for d in (model.good, model.bad)]
        x = ((size[1] - size[0]) / max(1, sum(size)), math.log(max(1, sum(size)) / (2 * max(1, len(texts[r["doc_id"]])))))
        z = max(-30, min(30, sum(a * b for a, b in zip(x, model.curve, strict=False)) + model.curve[-1]))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def plain_line_dedup(texts, depth=4, least=3, support=5, share=0.6, long=50):
    """{id: lines that go}, by a tree in dictionaries; ids are unique and texts not null."""
    variable, held, lines = object(), defaultdict(set), []
    for i, text in texts.items():
        for n, line in enumerate(text.split("\n")):
            t = line.encode().split()
            masked = tuple(variable if re.search(rb"[0-9@/=\\_]", x) else x for x in t)
            named = len(t) >= least and any(x is not variable for x in masked)
            lines.append((i, n, tuple(t), masked, named))
            if named:
                held[len(t), masked[:depth], masked].add(i)
    leaves, places, template, common = Counter(), Counter(), {}, Counter()
    for (size, lead, masked), docs in held.items():
        leaves[size, lead] += len(docs)
    held = {k: len(d) for k, d in held.items() if leaves[k[:2]] >= support}
    for (size, lead, masked), n in held.items():
        for p, x in enumerate(masked):
            places[size, lead, p, x] += n
    for size, lead, masked in held:
        kept = tuple(x if x is not variable and places[size, lead, p, x] >= support else None for p, x in enumerate(masked))
        template[size, lead, masked] = kept if sum(x is not None for x in kept) / size >= share else masked
        common[size, lead, template[size, lead, masked]] += held[size, lead, masked]
    found, exact = defaultdict(list), defaultdict(set)
    for i, n, t, masked, named in lines:
        key = (len(t), masked[:depth], masked)
        if named and key in template and common[len(t), masked[:depth], template[key]] >= support:
            found["template", len(t), masked[:depth], template[key]].append((i, n))
        if len(t) >= long:
            exact[t].add(texts[i])
    for i, n, t, _, _ in lines:
        if len(exact.get(t, ())) > 1:
            found["exact", t].append((i, n))
    gone = defaultdict(set)
    for places_ in found.values():
        for i, n in sorted(places_)[1:]:
            gone[i].add(n)
    return gone


@pytest.mark.parametrize("at", [DIR, "/root/testdata/sf0.01"])
def test_op8(spark, at):
    texts = {r["doc_id"]: r["text"] for r in documents(at)}
    gone = plain_line_dedup({i: t for i, t in texts.items() if t is not None})
    want = {i: (len(gone[i]), t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_dropped"], r["text"]) for r in answer(spark, "op8_line_dedup", at)} == want


def test_op9(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path(packing.TOKENIZER))
    rows = answer(spark, "op9_packing")
    want = set()
    for r in documents():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            piece = ids[a : a + 4096]
            want.add((r["doc_id"], k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert len(rows) == len(want) and {tuple(r)[:5] for r in rows} == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096
    tasks = spark.read.parquet(f"{DIR}/documents.parquet").rdd.getNumPartitions()
    assert len(held) <= 1.02 * sum(r["length"] for r in rows) / 4096 + 2 * tasks


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_decides_placements(rule):
    rng = np.random.default_rng(5)
    packer = packing.Packer(4096, 16, 0.9 * 4096**2, (1.0, 0.02, 0.02), rule)
    sizes = np.sort(np.concatenate((rng.integers(3800, 4096, 60), rng.integers(1, 2000, 900), rng.integers(1, 40, 3000))))[::-1]
    for n in sizes:
        packer.place(int(n))
    assert packer.decided[0] > 0 and packer.decided[2] > 0 and packer.closed[1] > 0
    assert packer.opened <= 1.7 * max(sizes.sum() / 4096, len(sizes) / 16)


def test_ids_by_hash_equal_text_ids():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tessera.llm.shared import hash_words, text_slices
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(public.path(packing.TOKENIZER)), random.Random(13)
    letters = "ab Z9'sStT.,!-_é́ñ  \x1c\x85\x0b\t\n<|>İΣς ﬁ中🙂'll're\"(0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a <|endoftext|> b", "x<|startoftext|>y, z", "plain again, a b"] * 2
    store = packing.HashedWords(packing.tokenizer())
    for limit in (512, 4096):
        for i, j, buf, offsets in text_slices(pa.array(texts), limit):
            ids, first, size = store.encode(hash_words(buf, offsets, lower=False))
            assert size.sum() == len(ids)
            for k in range(j - i):
                assert ids[first[k] : first[k + 1]].tolist() == own.encode(texts[i + k], add_special_tokens=False).ids
