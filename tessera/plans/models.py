"""Queries that fit models, and those that review what fitted models predict.

Models are fitted once an input and their predictions written to the store; a query makes what it lacks
there, and reads the table.  SQL reads the same table where it cannot fit the model itself; naive Bayes is
fitted in SQL as a whole, and with it the vocabularies, features and folds that the others share.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import boosting, crossval, features, folds, metrics, models
from tessera.operators.store import Store, fingerprint, fingerprint_sql
from tessera.plans.catalog import _CHARS, _TOKENS, LABELS, ROWS, SPACE, _sql_profile, query, rounded, rows, table

_NB = f"""c AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL),
w AS (SELECT count(DISTINCT term) AS w FROM c), l AS (SELECT doc_id AS doc, lang AS label FROM documents),
s AS (SELECT label, term, sum(tf) AS n FROM c JOIN l USING (doc) GROUP BY ALL), g AS (SELECT label, sum(n) AS total FROM s GROUP BY label),
p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM l)) AS log_prior, any_value(coalesce(total, 0)) + (SELECT w FROM w) AS mass FROM l LEFT JOIN g USING (label) GROUP BY label),
t AS (SELECT label, term, ln((n + 1) / mass) AS log_p FROM s JOIN p USING (label))"""


def _nb(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return models.nb_fit(features.label_sums(d, "doc_id", "lang", T.tokens(F.lower("text"))), d.select(F.col("doc_id").alias("doc"), F.col("lang").alias("label")))


@query(f"WITH {_NB} SELECT label, count(*) AS terms, round(sum(log_p) / count(*), 9) AS mean_log_p, round(any_value(log_prior), 9) AS log_prior FROM t JOIN p USING (label) GROUP BY label")
def nb_sql_model(spark, sf_dir):
    terms, priors = _nb(table(spark, sf_dir, "documents"))
    return rounded(terms.join(priors, "label").groupBy("label").agg(F.count("*").alias("terms"), (F.sum("log_p") / F.count("*")).alias("mean_log_p"), F.first("log_prior").alias("log_prior")))


@query(f"WITH {_NB}, z AS (SELECT c.doc, p.label, any_value(p.log_prior) + sum(tf * coalesce(t.log_p, ln(1 / p.mass))) AS score FROM c CROSS JOIN p LEFT JOIN t ON t.label = p.label AND t.term = c.term GROUP BY ALL) SELECT doc, arg_max(label, score) AS prediction FROM z GROUP BY doc")
def nb_predict(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return models.nb_predict(features.document_counts(d, "doc_id", T.tokens(F.lower("text"))), *_nb(d)).select("doc", "prediction")


# --- models that are fitted once ------------------------------------------------------------------

LR, SVM, NB, TREES = "logistic_regression_c1_balanced", "linear_svm_c0_5", "multinomial_nb", "boosted_trees"
SCORES = ("accuracy", "balanced_accuracy", "macro_f1", "mcc")
#: Folds that are validated; the model of the protected fold is trained on all of these.
FOLDS = (1, 2, 3, 4)
MODEL_FOLDS = (*FOLDS, crossval.PROTECTED)
BLOCKS = ("word", "character")
FIT = {
    LR: lambda data: crossval.fit_logistic(data, 1.0, balanced=True),
    SVM: lambda data: crossval.fit_squared_hinge(data, 0.5),
    NB: lambda data: crossval.fit_naive_bayes(data),
}
# fixed values: the configuration of boosted trees
BOOSTING = {"rounds": 100, "depth": 6, "rate": 0.1, "rows": 0.8, "columns": 0.5, "seed": 42}
TREE_ROWS = "round int, fold int, class int, node int, feature int, bin int, absent_left boolean, gain double, value double"
SETTINGS = {"blocks": BLOCKS, "folds": MODEL_FOLDS, "cap": 60_000, "profile": "p1"}


def _number(label: Column) -> Column:
    """The place of a label in the domain, null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), label), F.lit(0)) - 1


def _named(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), number)


def input_store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(spark, fingerprint(table(spark, sf_dir, "documents"), "doc_id", "lang", "text"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).withColumn("number", _number(F.col("label")))


class Fits:
    """The features and models of an input, fitted where the store lacks them."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "group"):
        self.spark, self.sf_dir, self.kind, self.store = spark, sf_dir, kind, input_store(spark, sf_dir)

    def frame(self) -> DataFrame:
        df = _labelled(self.spark, self.sf_dir)
        if self.kind == "random":  # folds that do not heed groups
            df = folds.with_random_fold(df, "label", "row_id").drop("fold").withColumnRenamed("random_fold", "fold")
        return df

    @functools.cached_property
    def features(self) -> crossval.FoldFeatures:
        def make() -> dict:
            def keep(vectors: DataFrame) -> DataFrame:
                self.store.write(vectors, "vectors", self.kind)
                return self.store.read("vectors", self.kind)

            made, _ = crossval.fit_features(self.frame(), "row_id", "text", "number", "fold", T.profile_p1, BLOCKS, MODEL_FOLDS, SETTINGS["cap"], keep)
            self.store.write(made.table, "vocabulary", self.kind)
            return {"features": made.sizes()}

        self.store.once(f"features-{self.kind}", SETTINGS, make)
        return crossval.features_of(self.store.read("vocabulary", self.kind), T.profile_p1, BLOCKS, MODEL_FOLDS)

    @functools.cached_property
    def problems(self) -> crossval.Problems:
        f = self.features
        return crossval.Problems(self.store.read("vectors", self.kind), len(LABELS), MODEL_FOLDS, f.idf.shape[1], f.idf, tuple(f.starts))

    def model(self, name: str) -> crossval.Fitted:
        """A model and its predictions of every row by the model that did not train on the row's fold."""

        def make() -> dict:
            fitted = FIT[name](self.problems)
            self.store.write_fitted(fitted, f"{self.kind}-{name}")
            self.out_of_fold(name, crossval.predict(self.problems, fitted))
            return {"passes": fitted.passes, "loss": fitted.loss.tolist()}

        self.store.once(f"model-{self.kind}-{name}", SETTINGS | {"model": name}, make)
        return self.store.read_fitted(f"{self.kind}-{name}")

    def out_of_fold(self, name: str, predicted: DataFrame) -> None:
        """Predictions of the folds and the scores of those that are validated."""
        condition = "clean" if self.kind == "group" else "random_folds"
        self.predictions(name, condition, predicted)
        pooled = self.read().where((F.col("model") == name) & (F.col("condition") == condition) & (F.col("fold") != crossval.PROTECTED))
        told = metrics.headline_by(pooled, [], len(LABELS))
        self.store.write(told.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in SCORES])).alias("m")).select("m.*"), "records", f"model={name}", f"condition={condition}")

    def boosted(self) -> None:
        """Boosted trees of the folds that are validated: their predictions, and a table of their nodes."""

        def make() -> dict:
            f = self.features
            data = crossval.Problems(self.store.read("vectors", self.kind), len(LABELS), FOLDS, f.idf.shape[1], f.idf[: len(FOLDS)], tuple(f.starts))
            fitted = boosting.fit_boosted(data, **BOOSTING)
            self.store.write(self.spark.createDataFrame(boosting.tree_rows(fitted), TREE_ROWS), "trees", f"model={TREES}", f"condition={self.kind}")
            self.out_of_fold(TREES, boosting.predict_boosted(data, fitted))
            data.close()
            return {"rounds": len(fitted.feature)}

        self.store.once(f"model-{self.kind}-{TREES}", SETTINGS | BOOSTING, make)

    def predictions(self, model: str, condition: str, predicted: DataFrame, kind: str = "predictions") -> None:
        told = predicted.select(F.col("doc").cast("long").alias("doc"), "fold", _named(F.col("label")).alias("truth"), _named(F.col("prediction")).alias("prediction"), "confidence")
        self.store.write(told, kind, f"model={model}", f"condition={condition}")

    def apply(self, model: str, condition: str, df: DataFrame, own_fold: bool = True, kind: str = "predictions") -> None:
        """Predictions of other texts, df (row_id, text, number, fold), written once."""

        def vectors() -> dict:
            self.store.write(self.features.rows(df, "row_id", "text", "number"), "vectors", condition)
            return {}

        def make() -> dict:
            fitted = self.model(model)
            self.store.once(f"vectors-{condition}", SETTINGS, vectors)
            self.predictions(model, condition, crossval.predict(self.problems, fitted, self.store.read("vectors", condition), own_fold), kind)
            return {}

        self.store.once(f"{kind}-{model}-{condition}", SETTINGS | {"model": model}, make)

    def read(self, kind: str = "predictions") -> DataFrame:
        return self.spark.read.option("basePath", self.store.path(kind)).parquet(self.store.path(kind))

    def close(self) -> None:
        if "problems" in self.__dict__:
            self.problems.close()


#: Stands in SQL for the folder of the store, which the session names.
STORE = "@store@"


def read_sql(kind: str = "predictions", of: str = "documents", told: tuple[str, ...] = ("doc_id", "lang", "text"), at: str = "model=*/condition=*") -> str:
    """A table of the store, of the input that the tables at hand are."""
    return f"(SELECT * FROM read_parquet('{STORE}/{kind}/input=*/{at}/*.parquet', hive_partitioning = true, hive_types_autocast = false, filename = true) WHERE input = {fingerprint_sql(of, *told)})"


def headline_sql(preds: str, by: str) -> str:
    return f"""hp AS ({preds}), hc AS (SELECT {by}, truth, prediction, count(*) AS n FROM hp GROUP BY ALL),
hl AS (SELECT {by}, label, sum(s) AS s, sum(p) AS p, sum(h) AS h FROM (SELECT {by}, truth AS label, n AS s, 0 AS p, CASE WHEN truth = prediction THEN n ELSE 0 END AS h FROM hc UNION ALL SELECT {by}, prediction, 0, n, 0 FROM hc) GROUP BY ALL),
hm AS (SELECT {by}, sum(s)::bigint AS rows, sum(h) / sum(s) AS accuracy, avg(h / s) FILTER (s > 0) AS balanced_accuracy, avg(2 * h / (s + p)) AS macro_f1, (sum(h)::double * sum(s) - sum(s::double * p)) / (sqrt(sum(s)::double * sum(s) - sum(p::double * p)) * sqrt(sum(s)::double * sum(s) - sum(s::double * s))) AS mcc FROM hl GROUP BY ALL)"""


def cv_sql(preds: str) -> str:
    """By fold, pooled, and mean and deviation over folds."""
    cols = ", ".join(f"round({c}, 9) AS {c}" for c in SCORES)
    over = lambda f: ", ".join(f"round({f}({c}), 9) AS {c}" for c in SCORES)
    return f"""{headline_sql(f"SELECT fold::varchar AS part, truth, prediction FROM ({preds}) UNION ALL SELECT 'pooled', truth, prediction FROM ({preds})", "part")}
SELECT part, rows, {cols} FROM hm UNION ALL SELECT 'mean', sum(rows)::bigint, {over("avg")} FROM hm WHERE part <> 'pooled' UNION ALL SELECT 'deviation', sum(rows)::bigint, {over("stddev_pop")} FROM hm WHERE part <> 'pooled'"""


def cv_records(predicted: DataFrame, classes: int) -> DataFrame:
    twice = predicted.select(F.explode(F.array(F.col("fold").cast("string"), F.lit("pooled"))).alias("part"), "truth", "prediction")
    by = metrics.headline_by(twice, ["part"], classes).select("part", "rows", *SCORES)
    each = by.where("part <> 'pooled'")
    summary = lambda name, f: each.agg(F.sum("rows").alias("rows"), *[f(c).alias(c) for c in SCORES]).select(F.lit(name).alias("part"), "rows", *SCORES)
    return rounded(by.unionByName(summary("mean", F.avg)).unionByName(summary("deviation", F.stddev_pop)))


def _model_cv(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    fits = Fits(spark, sf_dir)
    if model == TREES:
        fits.boosted()
    else:
        fits.model(model)
    fits.close()
    return cv_records(fits.read().where((F.col("model") == model) & (F.col("condition") == "clean") & (F.col("fold") != crossval.PROTECTED)), len(LABELS))


def clean_sql(model: str, where: str = "fold <> 0") -> str:
    return f"SELECT * FROM {read_sql()} WHERE model = '{model}' AND condition = 'clean' AND {where}"


@query("WITH " + cv_sql(clean_sql(LR)))
def lr_cv(spark, sf_dir):
    """Balanced logistic regression on words and characters: folds 1 to 4, up to 60,000 features a block, no validation text in the fit."""
    return _model_cv(spark, sf_dir, LR)


@query("WITH " + cv_sql(clean_sql(SVM)))
def svm_cv(spark, sf_dir):
    """The same with a squared-hinge linear SVM."""
    return _model_cv(spark, sf_dir, SVM)


def boosted_cv(spark, sf_dir):
    """Boosted trees under the softmax loss on the same features: 100 rounds of a tree a class, depth 6.

    Not registered: it has not ended within 330 s on 1,000 documents.
    """
    return _model_cv(spark, sf_dir, TREES)


_P1 = SPACE.format(_sql_profile(True, " <url> ", " <user> ", " hashtag_\\2 ", "text"))
_NB_CV = f"""d AS (SELECT row_id AS doc, label, fold, {_P1} AS text FROM ({ROWS})),
c AS (SELECT doc, label, fold, 'word' AS block, term, count(*) AS tf FROM (SELECT doc, label, fold, unnest({_TOKENS}) AS term FROM d UNION ALL SELECT doc, label, fold, unnest(list_transform(list_zip({_TOKENS}[:-2], {_TOKENS}[2:]), lambda p: p[1]||' '||p[2])) FROM d) GROUP BY ALL
UNION ALL SELECT doc, label, fold, 'character', term, count(*) FROM (SELECT doc, label, fold, unnest({_CHARS}) AS term FROM d) GROUP BY ALL),
f AS (SELECT a.fold AS model, count(*) AS n FROM (SELECT DISTINCT fold FROM d WHERE fold <> 0) a JOIN d ON d.fold <> a.fold AND d.fold <> 0 GROUP BY a.fold),
v AS (SELECT model, block, term, ln((1 + any_value(n)::double) / (1 + count(*))) + 1 AS idf FROM c JOIN f ON c.fold <> model AND c.fold <> 0 GROUP BY model, block, term HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n) QUALIFY row_number() OVER (PARTITION BY model, block ORDER BY sum(tf) DESC, term) <= 60000),
w AS (SELECT model, doc, label, fold, block, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (block, term) WHERE fold <> 0),
x AS (SELECT model, doc, label, fold, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY model, doc, block)) AS x FROM w),
s AS (SELECT model, label, block, term, sum(x) AS s FROM x WHERE fold <> model GROUP BY ALL),
wd AS (SELECT model, count(*) AS width FROM v GROUP BY model),
m AS (SELECT model, label, sum(s.s) + any_value(width) AS mass FROM s JOIN wd USING (model) GROUP BY model, label),
p AS (SELECT model, label, ln(count(*) / any_value(n)) AS prior FROM f JOIN d ON d.fold <> model AND d.fold <> 0 GROUP BY ALL),
z AS (SELECT a.doc, a.fold, a.label AS truth, p.label, any_value(p.prior) + coalesce(sum(x.x * (ln(coalesce(s.s, 0) + 1) - ln(m.mass))), 0) AS score FROM d a JOIN p ON p.model = a.fold JOIN m ON m.model = p.model AND m.label = p.label LEFT JOIN x ON x.doc = a.doc AND x.model = a.fold LEFT JOIN s ON s.model = x.model AND s.label = p.label AND s.block = x.block AND s.term = x.term GROUP BY ALL),
pred AS (SELECT doc, fold, truth, arg_max(label, score) AS prediction FROM z GROUP BY ALL)"""


@query(f"WITH {_NB_CV}, " + cv_sql("SELECT * FROM pred"))
def nb_cv(spark, sf_dir):
    """Naive Bayes on the same features; its SQL fits vocabularies, features and models from the texts."""
    return _model_cv(spark, sf_dir, NB)


# --- dense vectors ----------------------------------------------------------------------------------

_EMBEDDED = ("vec_id", "label", "floor(embedding[1]::double * 1000000)::bigint")


def _embedding_cv(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Ten labels on vectors of 64 entries, folds by a hash of the id."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", folds.group_fold(F.col("vec_id")))
    store = Store(spark, fingerprint(e, "vec_id", "label", F.floor(F.col("embedding")[0].cast("double") * 1000000).cast("long")))

    def make() -> dict:
        data = crossval.Problems(crossval.dense_rows(e, "vec_id", "embedding", "label", "fold", 64), 10, FOLDS, 64)
        fitted = FIT[model](data)
        out = crossval.predict(data, fitted).select(F.col("doc").cast("long").alias("doc"), "fold", F.col("label").cast("string").alias("truth"), F.col("prediction").cast("string").alias("prediction"), "confidence")
        store.write(out, "embedding_predictions", f"model={model}", "condition=clean")
        data.close()
        return {"passes": fitted.passes}

    store.once(f"embedding-{model}", {"model": model}, make)
    return cv_records(store.read("embedding_predictions", f"model={model}", "condition=clean"), 10)


def _embedding_sql(model: str) -> str:
    return "WITH " + cv_sql(f"SELECT * FROM {read_sql('embedding_predictions', 'embeddings', _EMBEDDED)} WHERE model = '{model}'")


@query(_embedding_sql(LR))
def embedding_cv(spark, sf_dir):
    """Logistic regression on dense vectors."""
    return _embedding_cv(spark, sf_dir, LR)


@query(_embedding_sql(SVM))
def embedding_svm_cv(spark, sf_dir):
    """A squared-hinge linear SVM on dense vectors."""
    return _embedding_cv(spark, sf_dir, SVM)
