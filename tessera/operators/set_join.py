"""Jaccard join of sets of hashes over size-banded tiles with bitmap signatures.

Every text becomes the sorted array of its distinct hashed shingles.  The
join finds each pair whose sets overlap by ``similarity``, and loses none:

* A band holds the sets of lo to 2 * lo - 1 shingles, and those up to
  1 / similarity larger that may be a partner of one.  Inside a band the hash
  space is cut into equal parts.  Two partners differ in at most d parts, so
  the parts they share number at least (parts - d); if either sorts its parts by
  an order of their contents, one of its first d + 1 is shared.  Only those are
  sent out, as 64-bit keys of a part's whole content.  The order puts parts of most
  rare shingles first: a sketch of fixed size, summed over all documents, says which
  shingles are frequent.  So a passage that many documents share makes no hot key.
* The smallest set of a key is its pivot, the pivot's members are its tile.
  Each member is first held against one pivot, in salted groups of bounded size.
  Members of the pivot's component are connected already.  Where many others are left,
  they are held against a few members more, chosen by a hash, and components are
  worked out anew.  Then come the other pivots of members that are still apart, and what
  is apart after them is held against its whole tile, in blocks of bounded size.  So a
  group of near copies costs rows in proportion to its size.
* Inside a tile, parity bitmaps of 512 bits or more bound the overlap from above; pairs that
  pass get an exact intersection of their sorted arrays.

Equal sets are one node throughout (classes); copies are never paired.  Sets are
compared by 64-bit hashes of words, shingles and sets: a wrong result needs a
collision of about N**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import connected_components, discard, materialize


SetsOf = Callable[[pa.Array], Iterator[np.ndarray]]
FAN_IN = 32
#: Bits of a bitmap, at least; sets of more shingles than half of that get more, up to the most.
BITS, MOST_BITS = 512, 1 << 16
#: Rows of a tile's group beside its pivot, and of a block, at most; and shingles of such rows.
GROUP, GROUP_SHINGLES = 1024, 1 << 20
#: Counters of the sketch, and how far over the mean a frequent shingle's counter is.
SKETCH, FREQUENT = 1 << 18, 1.5
#: Members that the rest of a large tile is held against in a round, and rounds.
SUBPIVOTS, ROUNDS = 32, 2
#: Loose members from which on a tile is large.
LARGE = 64

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most 1000 rows and 8 MB at once, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in group.column("sums").combine_chunks())
    return pa.table({"task": pa.array([group.column("task")[0].as_py() // FAN_IN], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def tree_sum(parts: DataFrame) -> list[np.ndarray]:
    """The sum of each block's rows, FAN_IN at a time: no task holds more rows of a block than that."""
    schema = "task int, block int, sums binary"
    parts = materialize(parts, "sums")
    while True:
        most = parts.agg(F.max("task")).first()[0] or 0
        parts = materialize(parts.groupBy("block", F.floor(F.col("task") / FAN_IN).alias("upper")).applyInArrow(_add, schema), "sums")
        if most < FAN_IN:
            return [np.frombuffer(r["sums"], "<f8") for r in parts.orderBy("block").collect()]  # one row a block


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], np.uint64)


def _step(k: int) -> np.uint64:
    return _STEP[k] if k < len(_STEP) else mix(np.array([k * 2 + 1], np.uint64))[0] | np.uint64(1)


def set_id(s: np.ndarray) -> int:
    """The 63-bit name of a set."""
    m = mix(s ^ np.uint64(0xA24BAED4963EE407))
    return int(mix(np.array([(int(m.sum(dtype=np.uint64)) * 31 + len(s)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] >> np.uint64(1))


def _counter(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SKETCH - 1)).astype(np.int64)


def part_keys(s: np.ndarray, similarity: Fraction, frequent: np.ndarray) -> np.ndarray:
    """The keys that a set sends out: d + 1 for each band that it belongs to."""
    rare = ~frequent[_counter(s)]
    n, top = len(s), 1 / similarity
    out = []
    band = n.bit_length() - 1
    hashed = mix(s)
    for i in (band, band - 1):
        lo = 1 << i if i >= 0 else 0
        largest = 2 * lo - 1
        if not lo or (i < band and n > largest * top):
            continue
        # |x ^ y| = a + b - 2 * overlap, and overlap >= similarity / (1 + similarity) * (a + b)
        share = 1 - 2 * similarity / (1 + similarity)
        most = int((largest + int(largest * top)) * share)
        parts = max(most + 1, 3 * lo // 4)
        differ = int((n + (int(n * top) if i == band else largest)) * share)
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(start, n))
        key = mix(np.add.reduceat(hashed, start) ^ (at[start] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(parts)))
        if differ + 1 > len(start):  # parts that hold nothing come last in the order, by number
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[start])[: differ + 1 - len(start)]
            key = np.concatenate((key, mix(empty * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(parts + (lo << 32)))))
        elif differ + 1 < len(start):
            key = key[np.lexsort((key, -count, -np.add.reduceat(rare, start, dtype=np.int64)))[: differ + 1]]
        out.append(key)
    return (np.concatenate(out) >> np.uint64(1)).astype(np.int64)


def bitmaps(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """A row of bits / 64 words for each set: bit h holds the parity of the shingles that fall on it."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        odd = np.flatnonzero(np.bincount((s >> np.uint64(7)) % np.uint64(bits), minlength=bits) & 1)
        np.bitwise_or.at(out[k], odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return out


def _enough(overlap, both, similarity: Fraction):
    """overlap / (both - overlap) >= similarity, in whole numbers."""
    p, q = similarity.numerator, similarity.denominator
    return (p + q) * overlap >= p * both


def overlap_of(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) else 0


def links_across(left: list[np.ndarray], right: list[np.ndarray], similarity: Fraction, joined=None) -> list[tuple[int, int]]:
    """Positions (i, j) of linked sets.  joined(i, j): already connected, so no need to know."""
    if not left or not right:
        return []
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    bits = min(MOST_BITS, max(BITS, 2 << int(max(n.max(), m.max())).bit_length()))
    a, b, out = bitmaps(left, bits), bitmaps(right, bits), []
    for i in range(len(left)):
        both = n[i] + m
        bound = (both - np.bitwise_count(a[i] ^ b).sum(1, dtype=np.int64)) // 2
        bound = np.minimum(bound, np.minimum(n[i], m))
        for j in np.flatnonzero(_enough(bound, both, similarity)).tolist():
            if joined is not None and joined(i, j):
                continue
            if _enough(overlap_of(left[i], right[j]), int(both[j]), similarity):
                out.append((i, j))
                if joined is not None:
                    joined(i, j, True)
    return out


def _counts(sets_of: SetsOf):
    def run(batches):
        total = np.zeros(SKETCH)
        for batch in batches:
            for s in sets_of(batch.column(0)):
                np.add.at(total, _counter(s), 1)
        task = TaskContext.get().partitionId()
        for k, part in enumerate(np.array_split(total, 16)):
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "block": pa.array([k], pa.int32()), "sums": [part.astype("<f8").tobytes()]})

    return run


def frequent_counters(texts: DataFrame, sets_of: SetsOf) -> np.ndarray:
    """Which of the sketch's counters hold a shingle of many documents; it only sets the order of parts, links do not depend on it."""
    parts = tree_sum(texts.select("text").mapInArrow(_counts(sets_of), "task int, block int, sums binary"))
    total = np.concatenate(parts) if parts else np.zeros(SKETCH)
    return total > FREQUENT * total.mean() + 4 * np.sqrt(total.mean())


def _describe(sets_of: SetsOf, similarity: Fraction, frequent: np.ndarray):
    def run(batches):
        seen: set[int] = set()  # sets whose keys this task has sent: 8 bytes a document
        for batch in batches:
            ids, sets, sizes, keys = batch.column(0), [], [], []
            for s in sets_of(batch.column(1)):
                name = set_id(s) if len(s) else None
                sizes.append(len(s))
                sets.append(name)
                keys.append(part_keys(s, similarity, frequent) if len(s) and name not in seen else None)
                seen.add(name)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "keys"])

    return run


def _arrays(sets_of: SetsOf):
    def run(batches):
        for batch in batches:
            # rows of one id may hold other texts than the one that was asked for
            sets = [(k, s) for k, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1)), strict=True) if len(s) and set_id(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["set_id", "shingles"])

    return run


def _groups(batches, keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys; the rows come sorted by them."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _against_pivot(similarity: Fraction):
    def run(batches):
        for (pivot, _), rows in _groups(batches, ["pivot", "salt"]):
            own = [np.frombuffer(r["shingles"], np.uint64) for r in rows if r["member"] == pivot][:1]
            rest = [r for r in rows if r["member"] != pivot]
            linked = {i for i, _ in links_across([np.frombuffer(r["shingles"], np.uint64) for r in rest], own, similarity)}
            yield pa.RecordBatch.from_pydict({"pivot": [pivot] * len(rest), "member": [r["member"] for r in rest], "linked": [i in linked for i in range(len(rest))]})

    return run


def _inside_tile(similarity: Fraction):
    def run(batches):
        for _, rows in _groups(batches, ["pivot", "row_block", "col_block"]):
            left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            def joined(i: int, j: int, join: bool = False) -> bool:
                a, b = find(left[i]["component"]), find(right[j]["component"])
                if join:
                    root[a] = b
                return a == b

            found = links_across([np.frombuffer(r["shingles"], np.uint64) for r in left], [np.frombuffer(r["shingles"], np.uint64) for r in right], similarity, joined)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [left[i]["member"] for i, _ in found], "b": [right[j]["member"] for _, j in found]})

    return run


def _rows():
    """Rows of a group of a tile, by its largest set."""
    return F.greatest(F.lit(8), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_SHINGLES) / F.col("largest"))))


def _linked_to_pivot(pairs: DataFrame, arrays: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) of those pairs (pivot, member, size) that are similar, in groups of a pivot and members of bounded size."""
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
    wide = pairs.join(sizes, "pivot").select("pivot", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / _rows())).alias("salt"))
    rows = wide.union(wide.select("pivot", F.col("pivot").alias("member"), "salt").distinct())
    rows = rows.join(arrays, rows.member == arrays.set_id).select("pivot", "salt", "member", "shingles")
    held = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt").mapInArrow(_against_pivot(similarity), "pivot long, member long, linked boolean")
    return held.where("linked").select(F.col("pivot").alias("a"), F.col("member").alias("b"))


def _apart(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sizes, stars): each tile's members with their component and whether it is not the pivot's; of tiles with such members n, loose and the rows of a group; the links, shortened."""
    found = connected_components(links)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    members = pairs.join(of("member"), "member", "left").join(of("pivot"), "pivot", "left")
    component = F.coalesce("member_in", "member")
    members = materialize(members.select("pivot", "member", "size", component.alias("component"), (component != F.coalesce("pivot_in", "pivot")).alias("apart")), "members")
    sizes = members.groupBy("pivot").agg(F.count("*").alias("n"), F.sum(F.col("apart").cast("long")).alias("loose"), F.max("size").alias("largest")).where("loose > 0 AND n > 1")
    return members, materialize(sizes.select("pivot", "n", "loose", _rows().alias("rows")), "sizes"), found.where("node <> component").toDF("a", "b")


def _blocks_of(left: DataFrame, right: DataFrame, arrays: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) across left and right rows (pivot, row_block, col_block, member, component) of equal blocks."""
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    rows = rows.join(arrays, rows.member == arrays.set_id).select("pivot", "row_block", "col_block", "side", "member", "component", "shingles")
    return rows.repartition("pivot", "row_block", "col_block").sortWithinPartitions("pivot", "row_block", "col_block", "side").mapInArrow(_inside_tile(similarity), "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str, text_col: str, sets_of: SetsOf, similarity: str | Fraction) -> DataFrame:
    """(doc_id, n_shingles, component_id): each row's set size and the smallest id that links reach.

    sets_of: the sorted distinct 64-bit hashes of each text of a column.  Texts with an empty set are
    linked with nothing: their component is their own id.  Rows of equal sets, repeated rows and ids
    among them, share a component; a null id counts as larger than any other, and stays null where it
    stands alone.  Connectivity is exact: every link between different sets is found or follows from links
    that were.
    """
    spark, s = docs.sparkSession, Fraction(similarity)
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(texts.mapInArrow(_describe(sets_of, s, frequent_counters(texts, sets_of)), "doc_id long, n_shingles long, set_id long, keys array<long>"), "described")
    told = materialize(described.select("doc_id", "n_shingles", "set_id"), "sets")
    classes = told.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))

    sent = described.where("keys IS NOT NULL").select("set_id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    # the first row of each key, sorted by set, is the pivot
    sent.createOrReplaceTempView(view := f"sent_{id(told)}")
    near = spark.sql(f"SELECT set_id AS member, size, first(set_id) OVER (PARTITION BY key ORDER BY set_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pivot FROM {view}").where("member <> pivot").distinct()
    tiles = materialize(near, "tiles")
    spark.catalog.dropTempView(view)
    discard(described)

    wanted = tiles.select(F.col("member").alias("set_id")).union(tiles.select(F.col("pivot").alias("set_id"))).distinct()
    chosen = classes.join(wanted, "set_id").select("set_id", F.col("first_id").alias("doc_id"))
    arrays = texts.join(chosen, texts.doc_id.eqNullSafe(chosen.doc_id)).select("set_id", "text").mapInArrow(_arrays(sets_of), "set_id long, shingles binary")
    arrays = materialize(arrays.dropDuplicates(["set_id"]), "shingles")
    discard()

    # each member against one pivot, then all other pairs that are still apart
    once = materialize(tiles.groupBy("member").agg(F.min("pivot").alias("pivot"), F.first("size").alias("size")), "once")
    members, sizes, links = _apart(once, _linked_to_pivot(once, arrays, s))
    of = lambda n, rows: F.ceil(F.col(n) / F.col(rows))
    block = lambda n: F.pmod(F.xxhash64("member"), of(n, "rows"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), of(n, "rows") - 1))
    for r in range(ROUNDS):
        large = sizes.where(F.col("loose") > LARGE)
        if large.isEmpty():
            break
        wide = members.join(large, "pivot")
        # about half of the few from the loose members
        draw = F.pmod(F.xxhash64("member", F.lit(r)), F.ceil(2 * F.when(F.col("apart"), F.col("loose")).otherwise(F.col("n")) / SUBPIVOTS)) == 0
        left = wide.where("apart").select("pivot", block("loose").alias("row_block"), F.lit(0).cast("long").alias("col_block"), "member", "component")
        right = wide.where(draw).select("pivot", spread("loose").alias("row_block"), F.lit(0).cast("long").alias("col_block"), "member", "component")
        old, (members, sizes, links) = (members, sizes), _apart(once, links.union(_blocks_of(left, right, arrays, s)))
        discard(*old)
    old, (members, sizes, links) = (members, sizes), _apart(tiles, links)
    discard(*old)
    rest = materialize(members.where("apart").select("pivot", "member", "size").join(once, ["pivot", "member"], "left_anti"), "rest")
    old, (members, sizes, links) = (members, sizes, rest), _apart(tiles, links.union(_linked_to_pivot(rest, arrays, s)))
    discard(*old)
    open_ = members.join(sizes, "pivot")
    left = open_.where("apart").select("pivot", block("loose").alias("row_block"), spread("n").alias("col_block"), "member", "component")
    right = open_.select("pivot", spread("loose").alias("row_block"), block("n").alias("col_block"), "member", "component")
    found = connected_components(links.union(_blocks_of(left, right, arrays, s)))
    discard(members, sizes, arrays, tiles, once)
    named = classes.join(found, classes.set_id == found.node, "left").select("set_id", "first_id", F.coalesce("component", "set_id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component"))
    named = named.join(lowest, "root").select("set_id", "component")
    return told.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
