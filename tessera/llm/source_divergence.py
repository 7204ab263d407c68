"""Operator 12: how far the sources of a language diverge, by wide term vectors.

A term's counts in the sources of its language stand in one row, as an array indexed by
source; a source that lacks the term is not stored.  Rows of equal arrays are merged
before anything is made of them.  Higher-order functions emit the pairs of sources to
which a row adds, beyond what two sources without the term have in common, which is the same for
all terms and is added once; partial sums are made before the shuffle.  Every figure is a
whole number, so no order of summing matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, hash_words, materialize, small_batches, table, text_slices

#: ASCII letters in lower case, all other ASCII as white space; what is beyond ASCII is a letter.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_FOLD[0x41:0x5B] += 32


def _share(n: str, mass: str) -> str:
    """SQL of 1 + floor(1e9 * (n + 1) / mass), by long division to base 1000: no product is over 1000 * mass."""
    a, b = f"({n} + 1L)", f"({mass})"
    r0 = f"({a} % {b})"
    r1 = f"({r0} * 1000L % {b})"
    r2 = f"({r1} * 1000L % {b})"
    return f"(1L + (({a} div {b} * 1000L + {r0} * 1000L div {b}) * 1000L + {r1} * 1000L div {b}) * 1000L + {r2} * 1000L div {b})"


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each (lang, source, term) of a slice of texts: occurrences, and documents that hold the term."""
    for batch in batches:
        lang, source = (c.dictionary_encode() for c in batch.columns[:2])
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        for i, j, buf, offsets in text_slices(batch.column(2)):
            w = hash_words(buf, offsets, lower=True, fold=_FOLD)
            if not len(w.hashes):
                continue
            order = np.argsort(w.hashes, kind="stable")  # so a term's documents stand in their order
            h, doc = w.hashes[order], np.repeat(np.arange(j - i), np.diff(w.first))[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            first = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))  # of a term in a document
            n = np.diff(np.append(first, len(h)))
            term = np.cumsum(new)[first] - 1
            key = term * (len(lang.dictionary) * len(source.dictionary)) + group[i:j][doc[first]]
            by = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
            one = by[at]
            place = order[first[one]]
            start, size = w.start[place], w.end[place] - w.start[place]
            ends = np.cumsum(size)
            letters = w.buf[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]))]
            terms = pa.StringArray.from_buffers(len(one), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(letters))
            code = group[i:j][doc[first[one]]]
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code // len(source.dictionary))), source.dictionary.take(pa.array(code % len(source.dictionary))), terms, pa.array(np.add.reduceat(n[by], at)), pa.array(np.diff(np.append(at, len(by))))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text), none of them null; counted in slices of texts first."""
    small_batches(docs.sparkSession)
    each = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank).

    A null language, source or text counts as ''.  A language keeps the terms that at least
    min_docs of its documents hold, V of them.  p = 1 + floor(1e9 * (n + 1) / (N + V)) of a term in a group of
    N kept occurrences, and the divergence of p from q is floor((p - q)^2 / q).  Part pair has each other
    source of the language with the divergence from it, summed over all kept terms: 0 where there
    are none.  Part term has the terms that a source uses more than its language does, the first `top` of each
    source.  rank counts from 1, larger values first, then items by their bytes.  Sources without any term
    are sources too; a language with one source has no pairs; rows that repeat count each; no
    rows give no rows; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    wide = term_counts(d).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("at"))  # a source has one entry
    wide = materialize(wide.where(F.col("docs") >= min_docs).select("lang", "term", "n", "at"), "wide")
    # a row a language: its V, its own N, and its sources in order, each with its N and its p of a term that it lacks
    masses = wide.select("lang", F.explode("at").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("mass"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("v"))
    groups = d.select("lang", "source").distinct().join(masses, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("mass", F.lit(0)).alias("mass")))).alias("g"))
    known = groups.join(kept, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), "g")
    langs = known.withColumns({"sources": F.expr("g.source"), "mass": F.expr("transform(g, x -> x.mass + v)"), "zero": F.expr(f"transform(g, x -> CASE WHEN x.mass + v > 0 THEN {_share('0L', 'x.mass + v')} END)"), "lang_mass": F.expr("aggregate(g, 0L, (a, x) -> a + x.mass) + v")}).drop("g")
    langs = materialize(langs, "langs")

    # part pair: rows of equal counts are one, with their number
    by_index = wide.join(langs.select("lang", "sources"), "lang").select("lang", F.expr("sort_array(transform(at, e -> named_struct('i', int(array_position(sources, e.source) - 1), 'n', e.n)))").alias("at"))
    merged = by_index.groupBy("lang", "at").agg(F.count("*").alias("times")).join(langs.select("lang", "mass", "zero"), "lang")
    shares = merged.select("lang", "times", "zero", F.expr(f"transform(at, e -> named_struct('i', e.i, 'p', {_share('e.n', 'get(mass, e.i)')}))").alias("at"))
    dense = shares.withColumns({"p": F.expr("transform(zero, (z, j) -> coalesce(get(filter(at, e -> e.i = j), 0).p, z))"), "has": F.expr("transform(zero, (z, j) -> exists(at, e -> e.i = j))")}).where("size(zero) > 1")
    # of the square of sources the cells of two different ones, of which one has the term
    cells = dense.select("lang", "times", "zero", "p", F.explode(F.expr("filter(sequence(0, size(p) * size(p) - 1), c -> c div size(p) <> c % size(p) AND (has[int(c div size(p))] OR has[c % size(p)]))")).alias("c"))
    a, b = "int(c div size(p))", "c % size(p)"
    beyond = F.expr(f"{_gap(f'p[{a}]', f'p[{b}]')} - {_gap(f'zero[{a}]', f'zero[{b}]')}")
    added = cells.select("lang", F.expr(a).alias("a"), F.expr(b).alias("b"), (beyond * F.col("times")).alias("f")).groupBy("lang", "a", "b").agg(F.sum("f").alias("added"))
    square = langs.select("lang", "v", "sources", "zero", F.explode(F.expr("sequence(0, size(sources) - 1)")).alias("a")).select("*", F.explode(F.expr("sequence(0, size(sources) - 1)")).alias("b")).where("a <> b")
    common = F.expr(f"CASE WHEN v > 0 THEN v * {_gap('zero[a]', 'zero[b]')} ELSE 0L END")
    pairs = square.select("lang", "a", "b", F.expr("sources[a]").alias("source"), F.expr("sources[b]").alias("item"), common.alias("common")).join(added, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("common") + F.coalesce("added", F.lit(0))).alias("value"))

    # part term: a source's rows are cut to the first before the shuffle
    told = wide.join(langs, "lang").select("lang", "term", "v", "sources", "mass", F.expr(_share("n", "lang_mass")).alias("q"), F.explode("at").alias("e"))
    told = told.select("lang", F.col("e.source").alias("source"), F.col("term").alias("item"), "q", F.expr(_share("e.n", "get(mass, int(array_position(sources, e.source) - 1))")).alias("p")).where("p > q")
    terms = told.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_gap("p", "q")).alias("value"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place))
    out = materialize(ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)), "divergence")
    discard(wide, langs)
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


_P = "1 + (1000000000::hugeint * ({n} + 1)) // ({mass} + v)"
_F = "(({p} - {q}) * ({p} - {q})) // {q}"

OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
o AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS mass FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, sum(n) AS mass FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", mass="coalesce(m.mass, 0)")} AS p, {_P.format(n="k.n", mass="v.mass")} AS q
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN m ON m.lang = g.lang AND m.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, ({_F.format(p="p", q="q")})::bigint FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 200"""
