"""Tall TF-IDF tables (doc, term, value) and their vector form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.functions.text import char_wb_ngrams, tokens, with_pairs
from tessera.operators import terms as counting
from tessera.operators.set_join import small_batches
from tessera.operators.tables import materialize, spread

#: Of each block what a text is cut into, once, and its terms from those.
ANALYZERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {"word": (tokens, with_pairs), "character": (lambda c: c, char_wb_ngrams)}


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(doc, term, tf)."""
    return df.select(F.col(key).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def analyzed_counts(df: DataFrame, key: str, text: Column, block: str) -> DataFrame:
    """(doc, term, tf) of a block's terms; the text is cut in a projection of its own."""
    cut, terms = ANALYZERS[block]
    return term_counts(df.select(key, cut(text).alias("cut")), key, terms(F.col("cut")))


def _parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key stands once, rows of other keys, or None where there are none)."""
    twice = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    if twice.isEmpty():
        return df, None
    twice = materialize(twice, "repeated")
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(twice, same, "left_anti"), df.join(twice, same, "left_semi")


def term_sums(df: DataFrame, key: str, text: Column, block: str) -> DataFrame:
    """(term, df, total) of a block's terms: counted inside each row, so that only sums by term are shuffled; rows of one key are one document."""
    small_batches(df.sparkSession)
    once, others = _parted(df, key)
    part = spread(once.select(text.alias("text"))).select(ANALYZERS[block][0](F.col("text")).alias("cut")).mapInArrow(counting.sums_by_term((block,)), "block string, term string, df long, total long").drop("block")
    if others is not None:
        part = part.unionByName(analyzed_counts(others, key, text, block).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def document_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(doc, term, tf) as term_counts has them, counted inside each row: only rows whose key stands twice are shuffled."""
    small_batches(df.sparkSession)
    once, others = _parted(df, key)
    told = spread(once.select(F.col(key).alias("doc"), terms.alias("cut")))
    schema = StructType([told.schema["doc"], StructField("term", StringType()), StructField("tf", LongType())])
    counts = told.mapInArrow(counting.counted_rows, schema)
    return counts if others is None else counts.unionByName(term_counts(others, key, terms))


def label_sums(df: DataFrame, key: str, label: str, terms: Column) -> DataFrame:
    """(label, term, n): the terms of each label's documents; a key that stands twice is one document under every label it has, a null one has none."""
    once, others = _parted(df.where(F.col(key).isNotNull()), key)
    told = spread(once.select(F.col(label).alias("label"), terms.alias("cut")))
    sums = told.select("label", F.explode("cut").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    if others is not None:
        labels = others.select(F.col(key).alias("doc"), F.col(label).alias("label"))
        sums = sums.unionByName(term_counts(others, key, terms).join(labels, "doc").groupBy("label", "term").agg(F.sum("tf").alias("n")))
        sums = sums.groupBy("label", "term").agg(F.sum("n").alias("n"))
    return sums


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, max_features: int | None = 60_000) -> DataFrame:
    """(term, df, total, idf) of counts (doc, term, tf): terms within the document-frequency bounds, capped by corpus frequency, ties by term."""
    return chosen(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n_docs, min_df, max_df, max_features)


def chosen(sums: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, max_features: int | None = 60_000) -> DataFrame:
    """The same of sums (term, df, total)."""
    terms = sums.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.withColumn("idf", F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1)


def weigh(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, term, value): sublinear tf, idf, unit length; terms out of the vocabulary drop out."""
    # the vocabulary is capped, so it is broadcast; without a cap join by shuffle
    raw = counts.join(vocab.select("term", "idf"), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("value"))


class TallTfidf:
    """Fitted on one table, applied to any: word, character, or both blocks side by side."""

    def __init__(self, kind: str = "combined", profile: Callable[[Column], Column] | None = None, word_max_features: int = 60_000, character_max_features: int = 60_000):
        if kind not in ("word", "character", "combined"):
            raise ValueError(f"unknown representation: {kind}")
        self.blocks = [kind] if kind != "combined" else ["word", "character"]
        self.profile, self.caps = profile or (lambda c: c), {"word": word_max_features, "character": character_max_features}
        self.vocabularies: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame, key: str, text: str) -> TallTfidf:
        n = df.count()
        self.vocabularies = {b: materialize(chosen(term_sums(df, key, self.profile(F.col(text)), b), n, max_features=self.caps[b]), "vocabulary") for b in self.blocks}
        return self

    def fit_transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """fit and transform of one table: its texts are cut twice, and no table of all terms of all texts is written."""
        return self.fit(df, key, text).transform(df, key, text)

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(doc, block, term, value); blocks have unit length each and are not weighed against each other."""
        small_batches(df.sparkSession)
        out = None
        once, others = _parted(df, key)
        told = spread(once.select(F.col(key).alias("doc"), self.profile(F.col(text)).alias("text")))
        for b in self.blocks:
            terms = self.vocabularies[b].select("term", "idf").toPandas()  # capped
            schema = StructType([told.schema["doc"], StructField("term", StringType()), StructField("value", DoubleType())])
            known = df.sparkSession.sparkContext.broadcast((terms["term"].tolist(), terms["idf"].to_numpy()))
            part = told.select("doc", ANALYZERS[b][0](F.col("text")).alias("cut")).mapInArrow(counting.weighed(b, known), schema)
            if others is not None:
                part = part.unionByName(weigh(analyzed_counts(others, key, self.profile(F.col(text)), b), self.vocabularies[b]))
            part = part.select("doc", F.lit(b).alias("block"), "term", "value")
            out = part if out is None else out.unionByName(part)
        return out

    def names(self) -> DataFrame:
        """(name, idx): the feature dictionary, block prefix first."""
        out = None
        for k, b in enumerate(self.blocks):
            part = self.vocabularies[b].select(F.lit(k).alias("block_no"), F.concat(F.lit(f"{b}__"), F.col("term")).alias("name"))
            out = part if out is None else out.unionByName(part)
        return out.withColumn("idx", (F.row_number().over(Window.orderBy("block_no", "name")) - 1).cast("int")).select("name", "idx")  # the vocabulary is capped


def assemble(tall: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, features): a sparse vector a document."""
    size = names.count()
    rows = tall.withColumn("name", F.concat_ws("__", "block", "term")).join(F.broadcast(names), "name")  # capped vocabulary
    packed = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("f"))
    # the fields of a sparse vector, as the vector type stores them; read back from a table they are vectors
    fields = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), F.col("f.idx").alias("indices"), F.col("f.value").alias("values"))
    return materialize(packed.select("doc", fields.alias("features")), "vectors", schema=StructType([packed.schema["doc"], StructField("features", VectorUDT())]))


def dense_features(df: DataFrame, key: str, embedding: str) -> DataFrame:
    return df.select(F.col(key).alias("doc"), array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))


def embedding_checks(df: DataFrame, embedding: str, dimension: int) -> DataFrame:
    """Rows, rows of another length, rows with a value that is not finite, rows not of unit length."""
    v = F.col(embedding)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(F.size(v) != dimension, 1)).alias("wrong_size"), F.count(F.when(odd, 1)).alias("not_finite"), F.count(F.when(F.abs(norm - 1) > 1e-3, 1)).alias("not_unit"))
