"""Queries over the test tables, an entry an operator, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit, features, folds, metrics, near, review
from tessera.operators.tables import materialize
from tessera.sources.files import file_hashes
from tessera.streaming.predict import predict_stream, run_to_table, windowed_counts

LABELS = ["de", "en", "es", "fr"]
STOP = ["the", "of", "and"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the frames that queries share, and the same in SQL -------------------------------------

SPACE = "regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
FOLD = "(('0x'||md5({}::varchar)[1:8])::bigint % 5)::int"
GROUP = f"md5({SPACE.format('lower(text)')})"
ROWS = f"SELECT doc_id AS row_id, text, lang AS label, {GROUP} AS grp, {FOLD.format(GROUP)} AS fold FROM documents"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled texts: language as label, equal normalised text as group, fold by group."""
    d = table(spark, sf_dir, "documents")
    group = F.md5(T.squeeze(F.lower("text")).cast("binary"))
    return d.select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"), group.alias("grp")).withColumn("fold", folds.group_fold(F.col("grp")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


H = "('0x'||md5('{}'||doc_id::varchar)[1:8])::bigint"
PREDICTIONS = f"""SELECT doc_id, lang AS truth, (['de','en','es','fr'])[1 + (list_position(['de','en','es','fr'], lang) - 1 + CASE WHEN {H.format('p')} % 10 < 3 THEN 1 + {H.format('q')} % 3 ELSE 0 END) % 4] AS prediction,
(['de','en','es','fr'])[1 + (list_position(['de','en','es','fr'], lang) - 1 + CASE WHEN {H.format('r')} % 10 < 4 THEN 1 ELSE 0 END) % 4] AS backup, ({H.format('c')} % 1001) / 1000.0::double AS confidence, {FOLD.format('doc_id')} AS fold FROM documents"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up predictions of two models: the label, turned for some documents by a hash of the id."""
    d = table(spark, sf_dir, "documents")
    labels = F.array(*map(F.lit, LABELS))
    h = lambda salt: folds.shared_hash(F.col("doc_id"), salt)
    turned = lambda by: F.element_at(labels, (F.pmod(F.array_position(labels, F.col("lang")) - 1 + by, F.lit(4)) + 1).cast("int"))
    p, b = F.when(h("p") % 10 < 3, 1 + h("q") % 3).otherwise(0), F.when(h("r") % 10 < 4, 1).otherwise(0)
    return d.select("doc_id", F.col("lang").alias("truth"), turned(p).alias("prediction"), turned(b).alias("backup"), ((h("c") % 1001) / 1000.0).alias("confidence"), folds.group_fold(F.col("doc_id")).alias("fold"))


def domain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(LABELS)], "label string, idx int")


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select([F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- audits and contracts ---------------------------------------------------------------------

_AUDIT = f"""WITH d AS (SELECT *, {SPACE.format('lower(text)')} AS t, coalesce(toxic::varchar, '<MISSING_LABEL>') AS l FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT t, l, count(*) n FROM d GROUP BY t, l), b AS (SELECT t, count(*) k, sum(n) n FROM p GROUP BY t),
w AS (SELECT count(*) n FROM d GROUP BY doc_id, text, lang, source, n_chars, quality, toxic)
SELECT (SELECT count(*) FROM p WHERE n > 1) AS duplicate_groups, (SELECT coalesce(sum(n), 0)::bigint FROM p WHERE n > 1) AS duplicate_rows, (SELECT sum(n - 1)::bigint FROM p) AS beyond_canonical,
(SELECT count(*) FROM b WHERE k > 1) AS conflicting_texts, (SELECT coalesce(sum(n), 0)::bigint FROM b WHERE k > 1) AS conflicting_rows,
(SELECT coalesce(sum(n), 0)::bigint FROM w WHERE n > 1) AS full_row_involved, (SELECT sum(n - 1)::bigint FROM w) AS full_row_beyond_first, (SELECT count(*) FROM d WHERE t = '') AS empty_texts, (SELECT count(*) FROM d) AS rows"""


@query(_AUDIT)
def duplicate_audit(spark, sf_dir):
    return audit.duplicate_audit(labelled(spark, sf_dir), T.squeeze(F.lower(T.coerce_text(F.col("text")))), F.col("toxic").cast("string"))


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")) + " FROM documents LEFT JOIN labels USING (doc_id)")
def null_counts(spark, sf_dir):
    return audit.null_counts(labelled(spark, sf_dir))


@query("SELECT DISTINCT lang AS label FROM documents WHERE lang NOT IN ('en', 'fr')")
def invalid_labels(spark, sf_dir):
    return audit.invalid_labels(table(spark, sf_dir, "documents"), "lang", ["en", "fr"])


@query("SELECT lang AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def class_counts(spark, sf_dir):
    return rounded(audit.class_counts(table(spark, sf_dir, "documents"), "lang", LABELS))


@query(f"SELECT row_id, fold FROM ({ROWS})")
def fold_assignment_group(spark, sf_dir):
    return rows(spark, sf_dir).select("row_id", "fold")


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY ('0x'||md5('42'||doc_id::varchar)[1:8])::bigint, doc_id) - 1) % 4 + 1)::int AS random_fold FROM documents")
def fold_assignment_stratified(spark, sf_dir):
    return folds.stratified_folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "random_fold")


@query("SELECT fold, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in LABELS) + f" FROM ({ROWS}) GROUP BY fold")
def fold_class_pivot(spark, sf_dir):
    return audit.class_pivot(rows(spark, sf_dir), "fold", "label", LABELS)


@query(f"SELECT fold, count(*) AS n FROM ({ROWS}) GROUP BY fold")
def fold_row_counts(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS groups, count(*) FILTER (size > 1) AS multi_row_groups, coalesce(sum(size) FILTER (size > 1), 0)::bigint AS rows_in_multi FROM (SELECT count(*) AS size FROM ({ROWS}) GROUP BY grp)")
def group_size_stats(spark, sf_dir):
    return audit.group_stats(rows(spark, sf_dir), "grp")


@query(f"SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM ({ROWS}) GROUP BY grp) GROUP BY size ORDER BY size LIMIT 8")
def group_size_histogram(spark, sf_dir):
    return audit.group_sizes(rows(spark, sf_dir), "grp").groupBy("size").agg(F.count("*").alias("groups")).orderBy("size").limit(8)  # the chart's first eight


_RANDOM = f"SELECT *, CASE WHEN fold = 0 THEN 0 ELSE ((row_number() OVER (PARTITION BY label, fold <> 0 ORDER BY ('0x'||md5('42'||row_id::varchar)[1:8])::bigint, row_id) - 1) % 4 + 1)::int END AS random_fold FROM ({ROWS})"


def _narrow_rows(spark, sf_dir):
    """The rows without their texts: groups are worked out of those once."""
    return materialize(rows(spark, sf_dir).drop("text"), "rows")


@query(f"SELECT grp, count(DISTINCT random_fold) AS folds FROM ({_RANDOM}) WHERE fold <> 0 GROUP BY grp HAVING count(DISTINCT random_fold) > 1")
def groups_crossing_folds(spark, sf_dir):
    """The groups that a stratified split without regard to groups tears apart."""
    return audit.crossing_groups(folds.with_random_fold(_narrow_rows(spark, sf_dir), "label", "row_id").where("fold <> 0"), "grp", "random_fold")


@query(f"SELECT row_id, fold, random_fold FROM ({_RANDOM})")
def random_fold_assignment(spark, sf_dir):
    return folds.with_random_fold(_narrow_rows(spark, sf_dir), "label", "row_id").select("row_id", "fold", "random_fold")


@query(f"""SELECT * FROM (VALUES
('repeated_row_ids', (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1))),
('unlabelled_documents', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))),
('labels_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))),
('groups_crossing_folds', (SELECT count(*) FROM (SELECT 1 FROM ({ROWS}) GROUP BY grp HAVING count(DISTINCT fold) > 1))),
('folds_missing', (SELECT 5 - count(DISTINCT fold) FROM ({ROWS}))),
('embeddings_wrong_size', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64))) t(rule, violations)""")
def contract_violations(spark, sf_dir):
    r, d, l = rows(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    differ = audit.key_differences(d, l, "doc_id")
    count = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    parts = [
        count(audit.repeated_keys(d, "doc_id"), "repeated_row_ids"),
        count(differ.where("side = 'left'"), "unlabelled_documents"),
        count(differ.where("side = 'right'"), "labels_without_document"),
        count(audit.crossing_groups(r, "grp", "fold", nulls=True), "groups_crossing_folds"),
        r.agg((F.lit(5) - F.count_distinct("fold")).alias("violations")).select(F.lit("folds_missing").alias("rule"), "violations"),
        features.embedding_checks(table(spark, sf_dir, "embeddings"), "embedding", 64).select(F.lit("embeddings_wrong_size").alias("rule"), F.col("wrong_size").alias("violations")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT sha256(string_agg(doc_id::varchar, chr(10) ORDER BY doc_id)) AS row_order_sha256, count(*) AS rows FROM documents")
def row_set_hash(spark, sf_dir):
    return audit.row_set_hash(table(spark, sf_dir, "documents"), "doc_id")


@query()
def file_hash(spark, sf_dir):
    return file_hashes(spark, f"{sf_dir}/region.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query(f"SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY row_id) AS n FROM ({ROWS})) WHERE n = 1")
def canonical_rows(spark, sf_dir):
    return audit.canonical_rows(rows(spark, sf_dir), ["grp", "label"], "row_id").select("row_id", "label")


@query(f"SELECT row_id, CASE WHEN fold = 2 THEN 'validation' ELSE 'train' END AS part FROM ({ROWS}) WHERE fold <> 0")
def train_validation_split(spark, sf_dir):
    train, valid = folds.split(rows(spark, sf_dir), 2)
    return train.select("row_id", F.lit("train").alias("part")).unionByName(valid.select("row_id", F.lit("validation").alias("part")))


@query("SELECT lang, max(count(*)) OVER () AS rows FROM documents GROUP BY lang")
def oversample_counts(spark, sf_dir):
    return folds.oversample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("rows"))


# --- text -----------------------------------------------------------------------------------

INJECTED = "text||' @u'||doc_id||' x@y #t_'||doc_id||' z#no http://X.y/@q/'||doc_id||' www.A.b sooo!!!!'"
_W = "[^\\p{L}\\p{N}\\p{M}_]"


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with addresses, users and hashtags put in: the texts have none."""
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", F.lit(" @u"), i, F.lit(" x@y #t_"), i, F.lit(" z#no http://X.y/@q/"), i, F.lit(" www.A.b sooo!!!!")).alias("text"))


def _sql_profile(lower: bool, url: str, user: str, hashtag: str | None, text: str = INJECTED) -> str:
    t = SPACE.format(text)
    t = f"lower({t})" if lower else t
    t = f"regexp_replace({t}, '(?i)(^|{_W})(?:https?://|www\\.)[^\\s<>\"]+', '\\1{url}', 'g')"
    t = f"regexp_replace({t}, '(^|{_W})@[A-Za-z0-9_]+', '\\1{user}', 'g')"
    if hashtag:
        t = f"regexp_replace({t}, '(^|{_W})#([\\p{{L}}\\p{{N}}_]+)', '\\1{hashtag}', 'g')"
    return t


@query(f"SELECT doc_id, md5({SPACE.format(INJECTED)}) AS text_md5 FROM documents")
def text_normalize(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, md5({SPACE.format(_sql_profile(False, ' <URL> ', ' <USER> ', None))}) AS text_md5 FROM documents")
def text_p0(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.md5(T.profile_p0(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, md5({SPACE.format(_sql_profile(True, ' <url> ', ' <user> ', ' hashtag_\\2 '))}) AS text_md5 FROM documents")
def text_p1(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.md5(T.profile_p1(F.col("text")).cast("binary")).alias("text_md5"))


_P2 = "array_to_string(list_filter(string_split(" + SPACE.format("regexp_replace(" + _sql_profile(True, " ", " ", " \\2 ") + ", '[^\\p{L}\\p{N}\\s]', ' ', 'g')") + ", ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and')), ' ')"


@query(f"SELECT doc_id, md5({_P2}) AS text_md5 FROM documents")
def text_p2(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.md5(T.profile_p2(F.col("text"), stop_words=STOP).cast("binary")).alias("text_md5"))


_PUNCT = "regexp_replace({}, '[\\p{{P}}\\p{{S}}]', ' ', 'g')"
_LEET = "translate({}, 'aeios', '43105')"
_MASK = "array_to_string(list_transform(regexp_extract_all({}, '\\p{{L}}{{5,}}|\\p{{L}}+|[^\\p{{L}}]+'), lambda x: CASE WHEN regexp_full_match(x, '\\p{{L}}{{5,}}') THEN substring(x, 1, 2)||repeat('*', length(x) - 3)||right(x, 1) ELSE x END), '')"
_REPEAT = "(SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, i, lag(c) OVER w AS a, lag(c, 2) OVER w AS b, lead(c) OVER w AS z FROM (SELECT unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i) WINDOW w AS (ORDER BY i)) WHERE NOT coalesce(c <> chr(10) AND c = a AND (c = b OR c = z), false))"


@query(f"SELECT doc_id, md5({_PUNCT.format('text')}) AS text_md5 FROM documents")
def perturb_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.remove_punctuation(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, md5(coalesce({_REPEAT}, '')) AS text_md5 FROM (SELECT doc_id, {INJECTED} AS text FROM documents)")
def perturb_repeats(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.md5(T.normalize_repeats(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, md5({_LEET.format('text')}) AS text_md5 FROM documents")
def perturb_leet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.leetspeak(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, md5({_MASK.format('text')}) AS text_md5 FROM documents")
def perturb_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.partial_masking(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT condition, count(*) AS n, sum(length(t))::bigint AS chars FROM (SELECT unnest([{'c': 'clean', 't': text}, {'c': 'remove_punctuation', 't': %s}, {'c': 'leetspeak', 't': %s}, {'c': 'partial_masking', 't': %s}], recursive := true) FROM documents) x(condition, t) GROUP BY condition" % (_PUNCT.format("text"), _LEET.format("text"), _MASK.format("text")))
def robustness_grid(spark, sf_dir):
    conditions = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), T.PERTURBATIONS[k](F.col("text")).alias("t")) for k in ("clean", "remove_punctuation", "leetspeak", "partial_masking")]))
    return table(spark, sf_dir, "documents").select(conditions.alias("r")).select("r.*").groupBy("condition").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


# --- features --------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_NGRAMS = f"list_concat({_TOKENS}, list_transform(list_zip({_TOKENS}[:-2], {_TOKENS}[2:]), lambda p: p[1]||' '||p[2]))"
_CHARS = "flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform(list_filter([3, 4, 5], lambda n: n = 3 OR length(w) + 2 > n - 1), lambda n: list_transform(range(1, greatest(length(w) + 3 - n, 1) + 1), lambda i: substring(' '||w||' ', i, n))))))"


def _vocab_sql(terms: str, cap: int, where: str = "true") -> str:
    return f"""c AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM documents WHERE {where}) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE {where}),
v AS (SELECT term, count(*) AS df, sum(tf)::bigint AS total, ln((1 + any_value(n.n)::double) / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n.n) ORDER BY total DESC, term LIMIT {cap})"""


def _lowered(c: Column) -> Column:
    return F.lower(c)


def _vocab(spark, sf_dir, block, cap) -> DataFrame:
    t = features.TallTfidf(block, _lowered, cap, cap).fit(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rounded(t.vocabularies[block])


@query(f"WITH {_vocab_sql(_NGRAMS, 5000)} SELECT term, df, total, round(idf, 9) AS idf FROM v")
def word_vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir, "word", 5000)


@query(f"WITH {_vocab_sql(_CHARS, 5000)} SELECT term, df, total, round(idf, 9) AS idf FROM v")
def char_vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir, "character", 5000)


def _tfidf_sql(terms: str, cap: int, block: str) -> str:
    return f"WITH {_vocab_sql(terms, cap)}, r AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)) SELECT doc, '{block}' AS block, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS largest, round(sum(w) / sqrt(sum(w * w)), 6) AS total FROM r GROUP BY doc"


def _tfidf(spark, sf_dir, kind) -> DataFrame:
    """A digest of each document's vector."""
    d = table(spark, sf_dir, "documents")
    tall = features.TallTfidf(kind, _lowered, 2000, 2000).fit_transform(d, "doc_id", "text")
    return rounded(tall.groupBy("doc", "block").agg(F.count("*").alias("terms"), F.max("value").alias("largest"), F.sum("value").alias("total")), 6)


@query(_tfidf_sql(_NGRAMS, 2000, "word"))
def word_tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir, "word")


@query(_tfidf_sql(_CHARS, 2000, "character"))
def char_tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir, "character")


@query("SELECT * FROM (" + _tfidf_sql(_NGRAMS, 2000, "word") + ") UNION ALL SELECT * FROM (" + _tfidf_sql(_CHARS, 2000, "character") + ")")
def combined_tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir, "combined")


@query(f"WITH {_vocab_sql(_TOKENS, 2000, 'doc_id % 2 = 0')}, x AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE doc_id % 2 = 1) SELECT doc_id AS doc, count(*) AS known FROM x JOIN v USING (term) GROUP BY doc_id")
def oov_transform(spark, sf_dir):
    """Even ids fit the vocabulary, odd ones are read with it: words out of it drop out."""
    d = table(spark, sf_dir, "documents")
    train, valid = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    vocab = features.vocabulary(features.term_counts(train, "doc_id", T.tokens(F.lower("text"))), train.count(), max_features=2000)
    seen = features.term_counts(valid, "doc_id", T.tokens(F.lower("text"))).join(vocab.select("term"), "term")
    return seen.groupBy("doc").agg(F.sum("tf").alias("known"))


_NEAR = """WITH s AS (SELECT min(conv_id * 1000 + turn) AS id, list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substring(text, i, 5))) AS s FROM conversations WHERE text IS NOT NULL GROUP BY text)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) AS jaccard FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.s, b.s)) >= 0.5 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"""


@query(_NEAR)
def near_duplicate_pairs(spark, sf_dir):
    """Conversation turns that share half of their shingles: a low bar, so that there are some."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(near.near_pairs(turns, "id", "text", similarity=0.5))


@query()
def near_duplicate_groups(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 1e-3) AS not_unit FROM embeddings")
def embedding_checks(spark, sf_dir):
    return features.embedding_checks(table(spark, sf_dir, "embeddings"), "embedding", 64)


# --- metrics -----------------------------------------------------------------------------------


def _cells_sql(rows_sql: str = PREDICTIONS, labels: tuple[str, ...] = tuple(LABELS)) -> str:
    values = ", ".join(f"('{x}', {i})" for i, x in enumerate(labels))
    return f"""l(label, idx) AS (VALUES {values}), p AS ({rows_sql}),
cells AS (SELECT a.label AS truth, b.label AS prediction, a.idx AS truth_idx, b.idx AS prediction_idx, (SELECT count(*) FROM p WHERE p.truth = a.label AND p.prediction = b.label) AS n FROM l a, l b)"""


_PER_CLASS = """t AS (SELECT truth AS label, sum(n) AS support, sum(n) FILTER (truth = prediction) AS hits FROM cells GROUP BY truth), q AS (SELECT prediction AS label, sum(n) AS predicted FROM cells GROUP BY prediction),
k AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1, support, predicted, hits FROM t JOIN q USING (label))"""
_HEADLINE = """SELECT round(sum(hits) / sum(support), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (support + predicted > 0), 9) AS macro_f1, round(avg(f1), 9) AS macro_f1_all,
round((sum(hits)::double * sum(support) - sum(support * predicted)) / (sqrt(sum(support)::double * sum(support) - sum(predicted * predicted)) * sqrt(sum(support)::double * sum(support) - sum(support * support))), 9) AS mcc FROM k"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), domain(spark))


@query(f"WITH {_cells_sql()} SELECT truth, prediction, n FROM cells")
def confusion_matrix(spark, sf_dir):
    return cells(spark, sf_dir).select("truth", "prediction", "n")


@query(f"WITH {_cells_sql()}, {_PER_CLASS} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::bigint AS support FROM k")
def per_class_metrics(spark, sf_dir):
    return rounded(metrics.per_class(cells(spark, sf_dir)).select("label", "precision", "recall", "f1", "support"))


@query(f"WITH {_cells_sql()}, {_PER_CLASS} {_HEADLINE}")
def headline_metrics(spark, sf_dir):
    return rounded(metrics.headline(cells(spark, sf_dir)))


@query(f"SELECT round(avg(a), 9) AS accuracy_mean, round(stddev_pop(a), 9) AS accuracy_std, round(avg(c), 9) AS confidence_mean, round(stddev_pop(c), 9) AS confidence_std FROM (SELECT fold, avg((truth = prediction)::int) AS a, avg(confidence) AS c FROM ({PREDICTIONS}) WHERE fold <> 0 GROUP BY fold)")
def fold_summary(spark, sf_dir):
    by_fold = predictions(spark, sf_dir).where("fold <> 0").groupBy("fold").agg(F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return rounded(metrics.fold_summary(by_fold, ["accuracy", "confidence"]))


_BINARY = "SELECT count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM (SELECT toxic = 1 AS t, contains(lower(text), 'stupid') OR contains(lower(text), 'moron') AS p FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(fp / (tn + fp), 9) AS false_positive_rate FROM ({_BINARY})")
def binary_transfer(spark, sf_dir):
    """A rule of two words held against the toxic label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = F.contains(F.lower("text"), F.lit("stupid")) | F.contains(F.lower("text"), F.lit("moron"))
    return rounded(metrics.binary_metrics(d.select((F.col("toxic") == 1).alias("t"), found.alias("p")), F.col("t"), F.col("p")))


@query("WITH s AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::double) AS s FROM embeddings), e AS (SELECT vec_id, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM s) SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS confidence FROM e")
def softmax_confidence(spark, sf_dir):
    scores = F.slice(F.col("embedding").cast("array<double>"), 1, 6)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", F.array_max(T.softmax(scores)).alias("confidence")))


@query(f"SELECT min(confidence) AS min, round(quantile_cont(confidence, 0.25), 9) AS q25, round(quantile_cont(confidence, 0.5), 9) AS median, round(quantile_cont(confidence, 0.75), 9) AS q75, max(confidence) AS max, round(avg(confidence), 9) AS mean, round(avg((confidence < 0.45)::int), 9) AS referred_rate FROM ({PREDICTIONS})")
def confidence_distribution(spark, sf_dir):
    return rounded(metrics.confidence_distribution(predictions(spark, sf_dir), "confidence", 0.45))


# --- review ------------------------------------------------------------------------------------

_EDGES = ", ".join(f"({lo!r}::double, {hi!r}::double)" for lo, hi in review.calibration_bins())


@query(f"WITH e(lo, hi) AS (VALUES {_EDGES}), p AS ({PREDICTIONS}), b AS (SELECT lo, count(*) AS n, avg((truth = prediction)::int) AS a, avg(confidence) AS c FROM p JOIN e ON confidence >= lo AND confidence < hi GROUP BY lo) SELECT round(sum(n / (SELECT count(*) FROM p) * abs(a - c)), 9) AS ece FROM b")
def calibration_error(spark, sf_dir):
    return rounded(review.calibration_error(predictions(spark, sf_dir), "confidence", F.col("truth") == F.col("prediction")))


@query(f"WITH p AS ({PREDICTIONS}), t(threshold) AS (SELECT unnest([0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.70])::double) SELECT threshold, round(avg((confidence >= threshold)::int), 9) AS coverage, round(1 - avg((confidence >= threshold)::int), 9) AS referred_rate, round(avg((truth = prediction)::int) FILTER (confidence >= threshold), 9) AS accuracy_kept FROM p, t GROUP BY threshold")
def referral_curve(spark, sf_dir):
    return rounded(review.referral_curve(predictions(spark, sf_dir), "confidence", F.col("truth") == F.col("prediction")))


@query()
def bootstrap_interval(spark, sf_dir):
    return review.bootstrap_difference(predictions(spark, sf_dir), LABELS, "truth", "prediction", "backup")


@query(f"WITH {_cells_sql()} SELECT truth, prediction, n, row_number() OVER (ORDER BY n DESC, truth_idx, prediction_idx) AS place FROM cells WHERE truth <> prediction")
def error_pairs(spark, sf_dir):
    from pyspark.sql import Window

    pairs = review.error_pairs(cells(spark, sf_dir))
    return pairs.select("truth", "prediction", "n", F.row_number().over(Window.orderBy(F.desc("n"), "truth_idx", "prediction_idx")).cast("long").alias("place"))  # the square of the labels


@query(f"WITH {_cells_sql()} SELECT truth, prediction, n FROM cells WHERE truth <> prediction ORDER BY n DESC, truth_idx, prediction_idx LIMIT 6")
def top_errors(spark, sf_dir):
    return review.error_pairs(cells(spark, sf_dir)).limit(6).select("truth", "prediction", "n")  # the chart's six


@query("WITH c AS (SELECT label::varchar AS class, i AS idx, round(avg(embedding[i]::double), 12) AS coefficient FROM embeddings, range(1, 65) r(i) GROUP BY ALL) SELECT class, rank, idx::int AS idx, round(coefficient, 9) AS coefficient, 'dim__'||left('d'||idx, 1)||repeat('*', greatest(2, length('d'||idx) - 1)) AS masked_feature FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY coefficient DESC, idx DESC)::int AS rank FROM c) WHERE rank <= 5")
def top_coefficients(spark, sf_dir):
    """Mean vectors of the embedding labels as coefficients."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("class"), F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("class", (F.col("i") + 1).alias("idx")).agg(F.round(F.avg(F.col("x").cast("double")), 12).alias("coefficient"))
    top = review.top_coefficients(c)
    return rounded(top.select("class", "rank", "idx", "coefficient", F.concat(F.lit("dim__"), T.mask_feature(F.concat(F.lit("dim__d"), F.col("idx").cast("string")))).alias("masked_feature")))


# --- prediction --------------------------------------------------------------------------------

_C = "('0x'||md5(conv_id||':'||turn)[1:8])::bigint % 10001 / 10000.0::double"
_M = "CASE WHEN turn % 2 = 0 THEN 'logistic_regression' ELSE 'linear_svm' END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"""SELECT conv_id, turn, CASE WHEN b THEN 'invalid' ELSE role END AS category, CASE WHEN b THEN 0 ELSE round_even(c, 4) END AS confidence, b OR m <> 'logistic_regression' OR c < 0.45 AS needs_human_review,
CASE WHEN b THEN {_quoted(review.ASK_TEXT)} WHEN m <> 'logistic_regression' THEN {_quoted(review.COMPARISON)} WHEN c < 0.45 THEN {_quoted(review.LOW)} ELSE {_quoted(review.SUGGESTION)} END AS message
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' AS b, {_C} AS c, {_M} AS m FROM conversations)""")
def predict_batch(spark, sf_dir):
    """Conversation turns answered by a rule model: the role as category, a hash as confidence."""
    return _answered(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "category", "confidence", "needs_human_review", "message")


def _answered(df: DataFrame) -> DataFrame:
    c = folds.shared_hash(F.concat_ws(":", "conv_id", "turn")) % 10001 / 10000.0
    model = F.when(F.col("turn") % 2 == 0, "logistic_regression").otherwise("linear_svm")
    return review.respond(df, F.col("text"), model, F.col("role"), c, "logistic_regression", 0.45)


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 500 AS valid FROM conversations")
def request_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").between(1, 500).alias("valid"))


@query()
def predict_stream_batch(spark, sf_dir):
    """The same answers from a stream."""
    c = table(spark, sf_dir, "conversations")
    stream = predict_stream(spark, f"{sf_dir}/conversations.parquet" if _is_dir(spark, f"{sf_dir}/conversations.parquet") else f"{sf_dir}/conversations*.parquet", c.schema.simpleString()[7:-1].replace(":", " "), _answered)
    return run_to_table(stream.select("conv_id", "turn", "category", "confidence", "needs_human_review", "message"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# fixed values: the probe terms of each category
_IDENTITY = [("age", "young"), ("age", "old"), ("ethnicity", "Asian"), ("ethnicity", "European"), ("gender", "woman"), ("gender", "man"), ("religion", "Muslim"), ("religion", "Christian")]


@query("SELECT replace(lang, '_', ' ') AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share, round(count(*) / greatest(max(count(*)) OVER (), 0.01), 9) AS bar FROM documents GROUP BY lang")
def dashboard_summary(spark, sf_dir):
    c = audit.class_counts(table(spark, sf_dir, "documents"), "lang", LABELS)
    most = c.agg(F.greatest(F.max("n").cast("double"), F.lit(0.01)).alias("most"))
    return rounded(c.crossJoin(most).select(T.prettify(F.col("label")).alias("name"), "n", "share", (F.col("n") / F.col("most")).alias("bar")))
