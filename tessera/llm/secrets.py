"""Operator 10: secret scans by patterns and by a battery of randomness tests.

Patterns find assignments, access keys and hexadecimal runs.  Of every other long
token the encoding is inferred (hexadecimal, base32, base62, base64, base64url) and
three tests ask whether its symbols could be uniform draws: chi-squared over equal
classes of the alphabet, runs above and below the median, and serial correlation.
Fisher's method joins them to one figure, the p-value of "uniform": the larger, the
more random a token looks.

What is reported must be controlled against the other side, tokens that people write.
So the null hypothesis is "an ordinary token", and its distribution comes from decoys:
names, paths and numbered words of the same encoding and length, made from a fixed
list and, up to 79 characters, from the words of every document.  A token's p-value is the share of its
decoys that look at least as random; it must be "uniform" at a level of 0.001, too.  A Benjamini-Hochberg step over all tokens of the
corpus, weighted by their length, then bounds the share of ordinary tokens among those reported.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_NAMES = ("password", "passwd", "secret", "token", "api")
#: (name, pattern, order of symbols) from the narrowest.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bits that a token must be able to hold before a test of it says anything.
LEAST_BITS = 100
#: Lower ends of the length classes, each length up to 127 by itself, and bins of -log10(p).
#: Tokens and decoys are counted in cells: a group is an encoding and a length class, a cell a bin of it.
_LENGTHS = (*range(20, 128), *(128 << k for k in range(6)))
_BINS, _BINS_PER_UNIT = 400, 10
_GROUPS = len(ENCODINGS) * len(_LENGTHS)
#: Bin from which on the battery rejects "uniform" (p of 0.001): no such token is reported, whatever the decoys say.
_REJECTED = 3 * _BINS_PER_UNIT
#: Decoys of each group that do not depend on the corpus.
_FIXED_DECOYS = 1000
# fixed values: words that names in files and programs are made of
_PLAIN_WORDS = (
    "a an and as at be by for from in is it no of on or the to with account action active address admin array assets backup batch block buffer build cache category channel check client cluster column config content context control country "
    "current customer data date default delete device document domain download email entry error event export field file filter folder format function group handler header height "
    "history image import index input item label language layer length level library limit line list local location manager master member message method model module month name "
    "network number object offset option order output package page parent partner path payment photo point policy position price process product profile project property public "
    "query queue range record region release report request resource response result return review role rule sample schema search section server service session setting size source "
    "stage start state status storage string style summary system table target task template test text thread time title total type update upload user value version view week width window year"
).split()


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-12:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 200):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, math.exp(-x + a * math.log(x) - math.lgamma(a)) * h)


def chi_squared(symbols: list[int], size: int) -> float:
    """p of uniform symbols, over classes that each expect five draws or more."""
    classes = max(2, min(size, len(symbols) // 5))
    counts = [0] * classes
    share = [0] * classes
    for s in range(size):
        share[s * classes // size] += 1
    for s in symbols:
        counts[s * classes // size] += 1
    n = len(symbols)
    return _gamma_tail((classes - 1) / 2, sum((c - n * k / size) ** 2 / (n * k / size) for c, k in zip(counts, share, strict=True)) / 2)


def runs(symbols: list[int], size: int) -> float:
    """p of the number of runs in the lower and upper half of the alphabet."""
    high = [2 * s >= size for s in symbols]
    n1 = sum(high)
    n0 = len(high) - n1
    if not n0 or not n1:
        return min(1.0, 2.0 ** (1 - len(high)))
    n, found = n0 + n1, 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean, var = 2 * n0 * n1 / n + 1, 2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1))
    return math.erfc(abs(found - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def serial_correlation(symbols: list[int], size: int) -> float:
    """p of the correlation of neighbours."""
    n = len(symbols)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    if not var:
        return 2.0**-n
    r = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:], strict=False)) / var
    return math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, p of "uniformly random"); None if the token is in no encoding or too short for it."""
    body = token.rstrip("=")
    for name, pattern, alphabet in ENCODINGS:
        if pattern.fullmatch(body):
            break
    else:
        return None
    if len(body) * math.log2(len(alphabet)) < LEAST_BITS:
        return None
    at = {c: k for k, c in enumerate(alphabet)}
    symbols = [at[c] for c in (body.lower() if name == "hex" else body)]
    size = len(alphabet)
    p = [max(t(symbols, size), 1e-290) for t in (chi_squared, runs, serial_correlation)]
    if name.startswith("base6"):  # shares of capitals, small letters and digits
        groups = [sum(map(f, body)) for f in (str.isupper, str.islower, str.isdigit)]
        want = [len(body) * k / size for k in (26, 26, 10)]
        p.append(max(_gamma_tail(1.0, sum((g - w) ** 2 / w for g, w in zip(groups, want, strict=True)) / 2), 1e-290))
    fisher = -sum(map(math.log, p))
    return name, max(_gamma_tail(len(p), fisher), 1e-290)


def tested(token: str) -> tuple[int, float] | None:
    """(cell, p) of a token that mixes digits with letters and that the battery takes."""
    if any(map(str.isdigit, token)) and any(map(str.isalpha, token)):
        got = battery(token)
        if got:
            group = next(k for k, e in enumerate(ENCODINGS) if e[0] == got[0]) * len(_LENGTHS) + bisect.bisect_right(_LENGTHS, len(token)) - 1
            return group * _BINS + min(_BINS - 1, int(-math.log10(got[1]) * _BINS_PER_UNIT)), got[1]
    return None


def decoy(words: list[str], encoding: str, length: int, number: int) -> str:
    """A token of about a length such as people write: words and a number, joined as the encoding allows."""
    if encoding == "hex":
        letters = "".join(c for w in words for c in w.lower() if c in "abcdef")
        return (f"{number:08d}{letters[:6]}" * (length // 9 + 1))[:length]
    join = {"base64": "/", "base64url": "_-"[number % 2]}.get(encoding, "")
    take, size = [], 0
    for k in range(4 * length):
        w = words[k % len(words)]
        take.append(str(number) if k == 1 else w.capitalize() if encoding == "base62" else w)
        size += len(take[-1]) + len(join)
        if size >= length:
            break
    out = join.join(take)[:length]
    return out.upper().translate(str.maketrans("0189", "2367")) if encoding == "base32" else out


def _decoy_cell(words: list[str], seed: int, encoding: int, length_class: int) -> int | None:
    low = _LENGTHS[length_class]
    got = tested(decoy(words, ENCODINGS[encoding][0], low if low < 128 else low + seed % low, seed % 9973))
    return got and got[0]


@functools.cache
def fixed_decoys(group: int) -> Counter:
    """Cells of decoys of a group, from the fixed words; a few may fall into another group."""
    rng = random.Random(group)
    cells = (_decoy_cell(rng.sample(_PLAIN_WORDS, 12), rng.randrange(1 << 30), *divmod(group, len(_LENGTHS))) for _ in range(_FIXED_DECOYS))
    return Counter(x for x in cells if x is not None and x // _BINS == group)


_LETTERS = re.compile(r"[A-Za-z]{2,}")


def text_decoys(text: str) -> list[int]:
    """Cells of four decoys, from words at a place of the text that a hash names; the hash names encodings and length classes too."""
    if not text:
        return []
    seed = zlib.crc32(text.encode())
    at = seed % len(text)
    words = _LETTERS.findall(text, at, at + 400) or _LETTERS.findall(text, max(0, at - 400), at)
    cells = (_decoy_cell(words, seed >> 4, (seed + c) % len(ENCODINGS), (seed // 5 + 17 * c) % 60) for c in range(4)) if words else ()
    return [x for x in cells if x is not None]


def _named(low: str) -> bool:
    return any(x in low for x in _NAMES)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    out = []
    if (":" in text or "=" in text) and _named(text.lower()):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def random_candidates(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, cell) of other long tokens that the battery takes."""
    for m in _TOKEN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in known):
            got = tested(m[0])
            if got:
                yield m.start(), m.end(), got[0]


def _scan(batches):
    found = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    maybe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cell", pa.int32())]))
    for batch in batches:
        base, more, decoys = [], [], []
        for text in batch.column(1):
            t = text.as_py() or ""
            spans = pattern_spans(t)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            more.append([{"start": a, "end": b, "cell": c} for a, b, c in random_candidates(t, spans)])
            decoys.append(text_decoys(t))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, found), pa.array(more, maybe), pa.array(decoys, pa.list_(pa.int32()))], ["doc_id", "base", "maybe", "decoys"])


def discovery_cuts(tokens: dict[int, tuple[int, int]], decoys: Counter, rate: float) -> list[int]:
    """The largest reported bin of each group, -1 for none; tokens: (number, summed length) by cell.

    p of a cell: the share of its group's decoys in bins up to it.  Its weight is its tokens'
    mean length against that of all, and Benjamini-Hochberg goes over p by weight.
    """
    decoys = sum((fixed_decoys(g) for g in {cell // _BINS for cell in tokens}), Counter(decoys))
    of_group = Counter()
    for cell, n in decoys.items():
        of_group[cell // _BINS] += n
    tested_, symbols = (sum(x[k] for x in tokens.values()) for k in (0, 1))
    cells = []
    for cell, (n, length) in tokens.items():
        group = cell // _BINS
        like = sum(decoys[c] for c in range(group * _BINS, cell + 1))
        cells.append(((1 + like) / (1 + of_group[group]) / (length / n * tested_ / symbols), n, cell))
    cuts, below, reported = [-1] * _GROUPS, 0, 0.0
    for p, n, _ in sorted(cells):
        below += n
        if p <= rate * below / tested_:
            reported = p
    for p, _, cell in cells:
        if p <= reported and cell % _BINS < _REJECTED:
            cuts[cell // _BINS] = max(cuts[cell // _BINS], cell % _BINS)
    return cuts


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (start, kind, end), kind a number of KINDS.

    Positions are code points, end exclusive.  base holds the pattern matches, spans
    those and the random tokens, by start and kind.  rate bounds the share of ordinary
    tokens among the random ones reported.  A null or empty text has none; repeated rows are
    scanned each by itself (and count each as a test); a null id stays; other columns
    are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    told = materialize(rows.mapInArrow(_scan, f"doc_id {kind}, base array<struct<start:long,kind:int,end:long>>, maybe array<struct<start:long,end:long,cell:int>>, decoys array<int>"), "secrets")
    # a row a cell at most, of which there are _GROUPS * _BINS
    tokens = {r["cell"]: (r["n"], r["length"]) for r in told.select(F.explode("maybe").alias("m")).groupBy("m.cell").agg(F.count("*").alias("n"), F.sum(F.col("m.end") - F.col("m.start")).alias("length")).collect()}
    decoys = Counter({r["cell"]: r["count"] for r in told.select(F.explode("decoys").alias("cell")).groupBy("cell").count().collect()}) if tokens else Counter()
    cuts = F.array(*map(F.lit, discovery_cuts(tokens, decoys, rate)))
    reported = F.filter("maybe", lambda m: m["cell"] % _BINS <= F.element_at(cuts, F.floor(m["cell"] / _BINS).cast("int") + 1))
    random_ = F.transform(reported, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return told.select("doc_id", "base", F.array_sort(F.concat("base", random_)).alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def _number(kind: int):
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of each document's base spans, and all its spans, of every whole text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    number = [_number(k) for k in range(3)]
    return found.select("doc_id", *number, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
