"""Preprocessing and estimators on MLlib, with the scaling and encoding rules that the features expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, Normalizer, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranges import quantiles
from tidemark.trees.extra import ExtraTrees
from tidemark.trees.leafwise import LeafwiseBoosting
from tidemark.trees.newton import NewtonBoosting
from tidemark.trees.ordered import OrderedBoosting

MISSING = "__MISSING__"
KEPT = ("forest", "boosted", "forest_regressor", "boosted_regressor", "svm")  # MLlib keeps their rows and reads them again in each pass
ROWS_A_TASK = 50_000  # of those
VOCABULARY = 262_144  # different words of a text


def fit_imputer(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> dict:
    """Median of each number (0 if it has none), most frequent value of each category (the least on ties)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("r")).select("r.*") if numbers else None
    q = {r["c"]: r["q"][0] for r in quantiles(long.filter(~F.isnan("v")), "v", (0.5,), ("c",)).collect()} if numbers else {}
    fill = {c: float(q[c]) if q.get(c) is not None else 0.0 for c in numbers}
    for c in categories:
        top = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()
        fill[c] = top["v"] if top else MISSING
    return fill


def impute(df: DataFrame, fill: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)) if isinstance(v, float) else F.col(c).cast("string"), F.lit(v)) for c, v in fill.items()})


def fit_scaler(df: DataFrame, numbers: Sequence[str]) -> dict[str, float]:
    """Population standard deviation of each column, 1 where it is 0; columns aren't centred."""
    s = df.agg(*[F.stddev_pop(c).alias(c) for c in numbers]).first()
    return {c: float(s[c]) if s[c] else 1.0 for c in numbers}


def scale(df: DataFrame, deviations: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / d for c, d in deviations.items()})


ESTIMATORS = {
    "linear": lambda seed, **p: R.LinearRegression(labelCol="label", **p),
    "logistic": lambda seed, **p: C.LogisticRegression(labelCol="label", **p),
    "svm": lambda seed, **p: C.LinearSVC(labelCol="label", **p),
    "huber": lambda seed, **p: R.LinearRegression(labelCol="label", loss="huber", **p),
    "ordered_boosting": None,  # these read columns as they are, see ``build_pipeline``
    "leafwise_boosting": None,
    "newton_boosting": None,
    "extra_trees": None,
    "extra_trees_regressor": None,
    "forest": lambda seed, **p: C.RandomForestClassifier(labelCol="label", seed=seed, **p),
    "boosted": lambda seed, **p: C.GBTClassifier(labelCol="label", seed=seed, **p),
    "forest_regressor": lambda seed, **p: R.RandomForestRegressor(labelCol="label", seed=seed, **p),
    "boosted_regressor": lambda seed, **p: R.GBTRegressor(labelCol="label", seed=seed, **p),
}


def build_pipeline(kind: str, numbers: Sequence[str], categories: Sequence[str] = (), text: str | None = None, seed: int = 42, vocabulary: int = VOCABULARY, hashed: bool = False, **params) -> Pipeline:
    """One-hot categories (unknown values are all zeros), TF-IDF of a text, numbers as they are, then the estimator."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown estimator {kind!r}; known: {sorted(ESTIMATORS)}")
    if ESTIMATORS[kind] is None:
        if text:
            raise ValueError(f"{kind} reads numbers and categories, not texts")
        return Pipeline(stages=_trees(kind, numbers, categories, seed, params))
    learner = ESTIMATORS[kind](seed, **params)
    return Pipeline(stages=[*encoding(numbers, categories, text, vocabulary, hashed), _Dealt(learner) if kind in KEPT else learner])


class _Dealt(Estimator):
    """A learner whose tasks hold no more than about ``ROWS_A_TASK`` rows each, however few files the rows come from."""

    def __init__(self, learner: Estimator):
        super().__init__()
        self.learner = learner

    def _fit(self, df: DataFrame) -> Model:
        tasks = max(-(-df.count() // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
        return self.learner.fit(df.repartition(tasks))


class OneHotColumns(Estimator):
    """A column of 0 and 1 for each value of the categories; more than ``limit`` values of one are an error. Unknown values are all zeros."""

    def __init__(self, categories: Sequence[str], limit: int = 1_000):
        super().__init__()
        self.categories, self.limit = list(categories), limit

    def _fit(self, df: DataFrame) -> OneHotColumnsModel:
        values = []
        for c in self.categories:
            found = [r[0] for r in df.select(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))).distinct().limit(self.limit + 1).collect()]
            if len(found) > self.limit:
                raise ValueError(f"{c} has more than {self.limit} values")
            values += [(c, v) for v in sorted(found)]
        return OneHotColumnsModel(values)


class OneHotColumnsModel(Model):
    def __init__(self, values: Sequence[tuple[str, str]]):
        super().__init__()
        self.values = list(values)
        self.names = [f"__hot_{i}" for i in range(len(self.values))]

    def _transform(self, df: DataFrame) -> DataFrame:
        hot = {n: (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)) == v).cast("double") for n, (c, v) in zip(self.names, self.values, strict=True)}
        return df.withColumns(hot) if hot else df


class _AfterOneHot(Estimator):
    """One-hot columns and then a learner of numbers, which is told their names."""

    def __init__(self, numbers: Sequence[str], categories: Sequence[str], learner):
        super().__init__()
        self.numbers, self.categories, self.learner = list(numbers), list(categories), learner

    def _fit(self, df: DataFrame) -> PipelineModel:
        hot = OneHotColumns(self.categories).fit(df)
        return PipelineModel([hot, self.learner([*self.numbers, *hot.names]).fit(hot.transform(df))])


def _trees(kind: str, numbers: Sequence[str], categories: Sequence[str], seed: int, params: dict) -> list:
    if kind == "ordered_boosting":  # categories become statistics of earlier rows
        return [OrderedBoosting(numbers, categories, seed=seed, **params)]
    made = {
        "leafwise_boosting": lambda names: LeafwiseBoosting(names, seed=seed, **params),
        "newton_boosting": lambda names: NewtonBoosting(names, **params),
        "extra_trees": lambda names: ExtraTrees(names, seed=seed, **params),
        "extra_trees_regressor": lambda names: ExtraTrees(names, impurity="variance", seed=seed, **params),
    }[kind]
    return [_AfterOneHot(numbers, categories, made)]


class _Counted(CountVectorizer):
    """A vocabulary that is an error, not cut, where the words are more than its limit."""

    def _fit(self, dataset):
        model = super()._fit(dataset)
        if len(model.vocabulary) >= self.getVocabSize():
            raise ValueError(f"more than {self.getVocabSize() - 1} words: give a larger vocabulary, or hash them")
        return model


def encoding(numbers: Sequence[str], categories: Sequence[str] = (), text: str | None = None, vocabulary: int = VOCABULARY, hashed: bool = False) -> list:
    """The stages that make the column ``features``.

    Words of a text are two letters or digits of any script, or more. More different words than ``vocabulary`` are an
    error; ``hashed`` words share that many places instead.
    """
    stages, parts = [], list(numbers)
    if categories:
        index, hot = [f"_i_{c}" for c in categories], [f"_h_{c}" for c in categories]
        stages.append(StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))  # the last is the unknown
        parts += hot
    if text:
        words = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=vocabulary) if hashed else _Counted(inputCol="_tokens", outputCol="_tf", vocabSize=vocabulary + 1)
        stages += [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\w\w+", gaps=False), words, IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_tfidf")]
        parts.append("_tfidf")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def predict(model: PipelineModel, df: DataFrame, name: str = "pred_0") -> DataFrame:
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn(name, p).select(*df.columns, name)


def predict_mean(models: Sequence[PipelineModel], df: DataFrame, name: str = "pred_0") -> DataFrame:
    """Mean over the models of the folds."""
    out = df
    for i, m in enumerate(models):
        out = predict(m, out, f"_m{i}")
    return out.withColumn(name, sum((F.col(f"_m{i}") for i in range(len(models))), F.lit(0.0)) / len(models)).drop(*[f"_m{i}" for i in range(len(models))])


def out_of_fold(df: DataFrame, pipeline: Pipeline, folds, fold: str = "__fold__") -> DataFrame:
    """Predictions of each fold's validation rows by a model of its training rows alone; NULL for rows that no fold validates.

    ``folds``: what has ``numbers``, ``train``, ``valid`` and ``unvalidated``, as ``Intervals`` and ``Assigned`` of
    :mod:`tidemark.operators.intervals`. ``fold`` is the column that tells a row's fold.
    """
    out = folds.unvalidated(df).withColumns({fold: F.lit(-1), "pred_0": F.lit(None).cast("double")})
    for k in folds.numbers:
        model = pipeline.fit(folds.train(df, k))
        out = out.unionByName(predict(model, folds.valid(df, k).withColumn(fold, F.lit(k))))
    return out


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the places of the model's feature vectors: a number's column, a category's ``column_value``."""
    attrs = model.transform(df.limit(0)).schema["features"].metadata["ml_attr"]
    named = {a["idx"]: a.get("name", f"feature_{a['idx']}") for kind in attrs.get("attrs", {}).values() for a in kind}
    clean = lambda n: n.removeprefix("_h_").removeprefix("_i_")
    return [clean(named.get(i, f"feature_{i}")) for i in range(attrs["num_attrs"])]


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``feature, importance``: of trees the importances, of linear models the coefficients; the largest first."""
    last = model.stages[-1]
    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(model, df), values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc(F.abs("importance")), "feature")
