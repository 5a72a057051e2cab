"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each is a sparse logistic model
on the words of the text, on their starts (an inflected or compound word is seldom seen twice, its stem
is) and on the probabilities of the categories before it. In
training these come out of fold: a document's probability comes from a model that has
not seen its fold. The last category is the given label. The narrower
ones are labelled documents that hold a word of the category's seed list.

The models are fitted on at most ``LABELLED`` labelled documents; every document is scored, its whole text.
The vocabulary has at most ``VOCABULARY`` words and starts of that sample.

Cases: null or empty text has no words and gets the models' base probability. A category
without both kinds of documents has probability 0. Copies of a text lie in one
fold. Labels without a document and documents without a label are not trained on.
Repeated labels of a document count as their largest. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from editlift.functions.markup import let
from editlift.llm.common import staged, text_or_empty

LABELLED = 20_000
VOCABULARY = 40_000
#: Letters of the word starts.
STARTS = (4, 5, 6)
FOLDS = 2
#: Tasks of a training pass. The sample is bounded, so they are as well; with four a pass sums up in one stage.
FIT_TASKS = 4

#: Seed words of each category.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown"),
    "degrading": ("scum", "trash", "worthless"),
    "disgust": ("disgusting", "pathetic"),
}

TOXIC = "toxic"

#: Places of the vector that hold the probabilities of the categories: the first ones, the last category's in front.
SLOT = {c: len(SEEDS) - 1 - k for k, c in enumerate(SEEDS)}


def words(text: Column) -> Column:
    """Distinct words, and the starts of those as long: these end in a hyphen, which no word has."""
    start = lambda k: lambda w: F.concat(F.substring(w, 1, k), F.lit("-"))
    long = lambda k: lambda w: F.length(w) >= k
    # Split once: the words are used four times.
    return let(
        F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+", -1)),
        lambda plain: F.array_distinct(F.concat(plain, *(F.transform(F.filter(plain, long(k)), start(k)) for k in STARTS))),
    )


def trained(label: str) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_words", labelCol=label, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
        maxIter=15, regParam=0.001, elasticNetParam=1.0,
    )


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = LABELLED) -> DataFrame:
    """(words, fold, a label per category) of a bounded sample, chosen by hash of the id."""
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias(TOXIC)).where(F.col("_id").isNotNull() & F.col(TOXIC).isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    rows = df.select(df[id_col].alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    held = F.col("words")
    return rows.select(
        words(F.col("text")).alias("words"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), F.col(TOXIC).cast("double").alias(TOXIC)
    ).withColumns({c: (F.arrays_overlap(held, F.array(*map(F.lit, seeds))) & (F.col(TOXIC) > 0)).cast("double") for c, seeds in SEEDS.items()})


class ToxicityChain:
    """Fitted vocabulary and one model per category, in order."""

    def __init__(self, vocabulary: Model | None, models: dict[str, Model | None]) -> None:
        self.vocabulary, self.models = vocabulary, models

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, p_<category>.., toxic) for every row; toxic if any category is more likely than not."""
        rows = df.select(df[id_col].alias("id"), words(text_or_empty(text_col)).alias("words"))
        if self.vocabulary is not None:
            rows = vectors(self.vocabulary, rows)
        before: list[str] = []
        for name, model in self.models.items():
            rows = scored(rows, model, before, name)
            before.append(name)
        rows = rows.select(F.col("id").alias(id_col), *(F.round(f"p_{c}", 9).alias(f"p_{c}") for c in before))
        return rows.withColumn("toxic", F.greatest(*(f"p_{c}" for c in before)) >= 0.5)


def fit_vocabulary(sample: DataFrame) -> Model:
    """Words by frequency behind the slots: a slot's name comes more than once in every row, a word once at most."""
    named = [F.array_repeat(F.lit(f"-{c}"), len(SLOT) + 1 - at) for c, at in SLOT.items()]
    rows = sample.select(F.concat("words", *named).alias("words"))
    size = VOCABULARY + len(SLOT)
    return CountVectorizer(inputCol="words", outputCol="_words", binary=True, minDF=5, vocabSize=size).fit(rows)


def vectors(vocabulary: Model, rows: DataFrame) -> DataFrame:
    """``_words`` in place of the words, its slots empty. The attribute of each word is left out of the schema: no step
    reads them, and every plan in the driver would hold them all."""
    return vocabulary.transform(rows).drop("words").withMetadata("_words", {})


def scored(rows: DataFrame, model: Model | None, before: list[str], name: str) -> DataFrame:
    """Adds ``p_<name>`` to rows whose slots are empty: what they add to the margin comes from the columns."""
    if model is None:
        return rows.withColumn(f"p_{name}", F.lit(0.0))
    margin = vector_to_array("_raw")[1]
    for c in before:
        margin = margin + F.lit(float(model.coefficients[SLOT[c]])) * F.col(f"p_{c}")
    return model.transform(rows).withColumn(f"p_{name}", 1 / (1 + F.exp(-margin))).drop("_prob", "_raw", "_pred")


def predicted(rows: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``rows`` with the category's probability in its slot, the vector as the struct that stores it."""
    if model is None:
        probability, out = F.lit(0.0), rows
    else:
        probability, out = vector_to_array("_prob")[1], model.transform(rows).drop("_raw", "_pred")
    v = F.unwrap_udt("_words")
    filled = F.struct(
        v["type"].alias("type"), v["size"].alias("size"),
        F.concat(F.array(F.lit(SLOT[name])), v["indices"]).alias("indices"),
        F.concat(F.array(probability), v["values"]).alias("values"),
    )
    return out.select(*(filled.alias(c) if c == "_words" else c for c in rows.columns))


def vector_schema(schema: StructType) -> StructType:
    """The stored struct of ``predicted`` read as a vector."""
    return StructType([StructField(f.name, VectorUDT()) if f.name == "_words" else f for f in schema])


def fit_one(rows: DataFrame, label: str) -> Model:
    return trained(label).fit(rows.coalesce(FIT_TASKS))


def folds_of_both_kinds(rows: DataFrame, categories: list[str]) -> dict[str, set[int]]:
    """For each category the folds outside which it has both kinds of rows; ``FOLDS`` stands for no fold left out."""
    counts = rows.groupBy("fold").agg(*(F.sum(c).alias(c) for c in categories), F.count("*").alias("n")).collect()
    kept = {k: [row for row in counts if row["fold"] != k] for k in range(FOLDS + 1)}
    return {
        c: {k for k, rest in kept.items() if 0 < sum(row[c] for row in rest) < sum(row["n"] for row in rest)}
        for c in categories
    }


def fit_chain(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityChain:
    sample = staged(labelled_sample(df, labels, id_col, text_col), "toxicity")
    categories = [*SEEDS, TOXIC]
    # Copies would lend their label's noise to their words.
    sample = sample.dropDuplicates(["words"])
    if sample.isEmpty():
        return ToxicityChain(None, dict.fromkeys(categories))
    vocabulary = fit_vocabulary(sample)
    rows = staged(vectors(vocabulary, sample), "toxicity-words")
    fits = folds_of_both_kinds(rows, categories)
    models: dict[str, Model | None] = {}
    for name in categories:
        models[name] = fit_one(rows, name) if FOLDS in fits[name] else None
        if name == TOXIC:
            break
        folds = []
        for k in range(FOLDS):
            own = rows.where(F.col("fold") == k)
            model = fit_one(rows.where(F.col("fold") != k), name) if k in fits[name] else None
            folds.append(predicted(own, model, name))
        whole = folds[0]
        for f in folds[1:]:
            whole = whole.unionByName(f)
        rows = staged(whole, "toxicity-fold", vector_schema(whole.schema))
    return ToxicityChain(vocabulary, models)
