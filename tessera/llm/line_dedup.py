"""Operator 8: line dedup by a log-template tree.

A line is a leaf of a tree of fixed depth: its number of tokens, then its leading
tokens, with variable-looking tokens (digits, addresses, assignments) as wildcards.
Inside a leaf a token is constant if enough documents hold it at its position, and
variable otherwise; the constants and wildcards are the line's template.  A
template that enough documents hold recurs, and its lines are dropped but for the
first.  A long line needs no such support: where two different texts hold it token by
token, it is dropped but for the first.  Everything is counted by partial sums: leaves over all lines, positions
and templates over the distinct lines of leaves that several documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, hash_words, materialize, mix, small_batches, table, text_slices, unused

VARIABLE = np.uint64(0x5851F42D4C957F2D)
_ODD = np.zeros(256, bool)
_ODD[[*range(0x30, 0x3A), *b"@/=\\_"]] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def masked_lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, those with variable ones masked, first token of each line and one more, document, number in the document) of every line."""
    w = hash_words(buf, offsets, lower=False)
    odd = np.concatenate(([0], np.cumsum(_ODD[buf], dtype=np.int64)))
    tokens = np.where(odd[w.end] > odd[w.start], VARIABLE, w.hashes)
    breaks = np.flatnonzero(buf == 0x0A) + 1
    doc_start = offsets[:-1]
    line_start = np.sort(np.concatenate((doc_start, breaks)), kind="stable")  # an empty line starts where the next one does
    # a document's first line comes before the lines that its breaks begin
    doc = np.concatenate((np.arange(len(doc_start)), np.searchsorted(offsets[1:], breaks - 1, "right")))
    order = np.lexsort((np.concatenate((doc_start, breaks)), doc))
    doc, line_start = doc[order], np.concatenate((doc_start, breaks))[order]
    first = np.append(np.searchsorted(w.start, line_start), len(w.start))
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return w.hashes, tokens, first, doc, number


def _lines(depth: int, least: int, long: int):
    def run(batches):
        for batch in batches:
            keys, wholes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for i, _, buf, offsets in text_slices(batch.column(1)):
                plain, tokens, first, doc, number = masked_lines(buf, offsets)
                count = np.diff(first)
                full = np.flatnonzero(count >= max(1, min(least, long)))
                if not len(full):
                    continue
                a, n = first[full], count[full]
                place = np.arange(len(tokens)) - np.repeat(first[:-1], count)
                run_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens + place.astype(np.uint64) * _PLACE))))
                line = mix(run_[a + n] - run_[a] + n.astype(np.uint64))
                exact_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(plain + place.astype(np.uint64) * _PLACE))))
                exact = mix(exact_[a + n] - exact_[a] + n.astype(np.uint64))
                leaf = mix(run_[a + np.minimum(n, depth)] - run_[a] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                constant = np.concatenate(([0], np.cumsum(tokens != VARIABLE)))
                named = (n >= least) & (constant[a + n] > constant[a])  # a line of wildcards alone says nothing
                some = named | (n >= long)
                full, leaf, line, exact, named, n = full[some], leaf[some], line[some], exact[some], named[some], n[some]
                # the first of equal lines in a document speaks for it
                order = np.lexsort((number[full], line, doc[full]))
                same = np.zeros(len(full), bool)
                same[order[1:]] = (line[order][1:] == line[order][:-1]) & (doc[full][order][1:] == doc[full][order][:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i + doc[full]]), pa.array(wholes[i + doc[full]]), pa.array(number[full].astype(np.int32)), pa.array(leaf.view(np.int64), mask=~named), pa.array(line.view(np.int64)), pa.array(exact.view(np.int64), mask=n < long), pa.array(named & ~same)],
                    ["key", "whole", "line_no", "leaf", "line", "exact", "speaks"],
                )

    return run


def _tokens(batches) -> Iterator[pa.RecordBatch]:
    """The tokens of the asked lines of each text: wanted holds (line_no, leaf, line, docs)."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        for i, j, buf, offsets in text_slices(batch.column(0)):
            _, tokens, first, doc, number = masked_lines(buf, offsets)
            start = np.searchsorted(doc, np.arange(j - i))
            out: list[list] = [[], [], [], [], []]
            for k in range(i, j):
                for x in wanted[k]:
                    at = start[k - i] + x["line_no"]
                    got = tokens[first[at] : first[at + 1]].view(np.int64)
                    for c, v in zip(out, (np.full(len(got), x["leaf"]), np.full(len(got), x["line"]), np.full(len(got), x["docs"]), np.arange(len(got), dtype=np.int32), got), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["leaf", "line", "docs", "pos", "token"])


def recurring_lines(docs: DataFrame, key: str = "key", text: str = "text", order: str = "doc_id", depth: int = 4, least_tokens: int = 3, min_docs: int = 5, constant_share: float = 0.6, long_tokens: int = 50) -> DataFrame:
    """(key, line_no, template, first) of lines whose template min_docs documents hold, and of lines of long_tokens tokens that two different texts hold; first: the one to keep.

    A line of both kinds has two rows.  The first line of a template is the first of its equals, too.
    """
    small_batches(docs.sparkSession)
    lines = docs.select(key, text, F.xxhash64(text)).mapInArrow(_lines(depth, least_tokens, long_tokens), "key long, whole long, line_no int, leaf long, line long, exact long, speaks boolean")
    lines = materialize(lines, "lines")
    # equal lines are one row before a leaf's rows meet, so a frequent line makes no large leaf
    # where the first one stands is one number, key and line, so that the aggregate is hashed and not sorted
    place = F.col("key").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    every = lines.where("speaks").groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(place).alias("at"))
    every = every.withColumn("key", F.floor(F.col("at") / F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(20,0)"))
    number = F.col("at") - F.col("key") * F.lit(1 << 31).cast("decimal(10,0)")
    every = materialize(every.select("leaf", "line", "docs", F.col("key").cast("long").alias("key"), number.cast("int").alias("line_no")), "every")
    leaves = every.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    distinct = materialize(every.join(leaves, "leaf", "left_semi"), "distinct")
    discard(every)
    # what stands only once in its document, and is asked of it: no more than the document's lines
    asked = distinct.groupBy("key").agg(F.collect_list(F.struct("line_no", "leaf", "line", "docs")).alias("wanted"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(asked, "key").dropDuplicates(["key"]).select("text", "wanted")
    tokens = materialize(texts.mapInArrow(_tokens, "leaf long, line long, docs long, pos int, token long"), "tokens")
    support = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("held")).where((F.col("held") >= min_docs) & (F.col("token") != int(VARIABLE.view(np.int64))))
    known = tokens.join(support, ["leaf", "pos", "token"], "left")
    constant = F.col("held").isNotNull()
    named = known.groupBy("leaf", "line").agg(F.max("docs").alias("docs"), F.bit_xor(F.xxhash64("pos", F.when(constant, F.col("token")))).alias("general"), F.avg(constant.cast("double")).alias("share"))
    named = named.select("leaf", "line", "docs", F.when(F.col("share") >= constant_share, F.col("general")).otherwise(F.col("line")).alias("template"))
    common = named.groupBy("leaf", "template").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "template")
    named = materialize(named.join(common, ["leaf", "template"]).select("leaf", "line", "template"), "templates")
    discard(distinct, tokens)
    found = lines.where("leaf IS NOT NULL").join(named, ["leaf", "line"]).select("key", "line_no", "leaf", "template")
    # copies of one text are no recurring lines: the near-duplicate join finds them
    long = lines.where("exact IS NOT NULL")
    again = long.groupBy("exact").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("exact")
    found = found.unionByName(long.join(again, "exact").select("key", "line_no", F.lit(0).cast("long").alias("leaf"), F.col("exact").alias("template")))
    by_id = docs.select(F.col(key).alias("key"), F.col(order).alias("doc_id")).distinct()
    firsts = found.join(by_id, "key").groupBy("leaf", "template").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "line_no")).alias("f"))
    firsts = firsts.select("leaf", "template", F.col("f.key").alias("first_key"), F.col("f.line_no").alias("first_line"))
    return found.join(firsts, ["leaf", "template"]).select("key", "line_no", "template", ((F.col("key") == F.col("first_key")) & (F.col("line_no") == F.col("first_line"))).alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_dropped", **params) -> DataFrame:
    """docs with recurring lines cut out of the text, and n_dropped, the number of them.

    All columns of docs stay, in their order; a column of the name count_col, in any case, is
    replaced.  Lines are cut at \\n, and only whole ones go; blank lines and those of fewer
    than least_tokens tokens stay.  The first line of a template, or of equal long lines,
    by document id (a null id last), then by line, stays.  Copies of one text, whatever
    their ids, count as one text for long lines, so they alone lose none.  Rows of equal id and text count as one
    document and lose the same lines.  A null text stays null; an empty one stays
    empty; a text may become empty; no rows give no rows.
    """
    key, gone, gone_key = unused(docs, "_key", "_gone", "_gone_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    plain = keyed.where(F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    cuts = recurring_lines(plain, **params).where("NOT first").groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias(gone)).withColumnRenamed("key", gone_key)
    joined = keyed.join(cuts, (keyed[key] == cuts[gone_key]) & keyed[text_col].isNotNull(), "left")
    # a mark a line up to the last that goes, so each line is looked at once
    before = lambda k: F.coalesce(F.get(F.col(gone), k - 1), F.lit(-1))
    marks = F.flatten(F.transform(gone, lambda n, k: F.concat(F.array_repeat(F.lit(False), n - before(k) - 1), F.array(F.lit(True)))))
    kept = F.zip_with(F.split(F.col(text_col), "\n", -1), marks, lambda line, goes: F.when(~F.coalesce(goes, F.lit(False)), line))
    left = F.array_join(F.filter(kept, lambda line: line.isNotNull()), "\n")
    cut = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)
    dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return joined.select(*[(cut if c == text_col else F.col(c)).alias(c) for c in docs.columns if c.lower() != count_col.lower()], dropped.alias(count_col))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without recurring lines, and how many went; a null text stays null."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_dropped", F.octet_length("text").cast("long").alias("text_bytes"), "text")
