"""Secret scan: long tokens of a text, judged by a random forest.

Candidates are runs of 16 and more token characters with a digit among them. A
random forest on length, character transitions, dictionary coverage, path and
neighbouring words removes false findings. It is trained from labelled findings: given ones, or,
without any, a bounded sample of the findings labelled by
``audited``, which knows a secret by what it is assigned to. The dictionary are the
words that several of all documents share.
Everything is DataFrame functions and Spark ML.

Cases: null or empty text has no findings. Texts of any length are cut in one linear
pass. Equal candidates in a text are findings each. Without both kinds of
labelled findings no forest can be trained and ``audited`` decides itself. A null path
counts as an ordinary path; null ids keep their findings. An empty table has no findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import staged, text_or_empty
from editlift.session import broadcast_if_small

CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
SECRET_NAME = r"(?i)(key|token|secret|passw\w*|pwd|auth\w*|credential\w*|bearer|private)[\w\-]*[\"']?\s*[=:]?\s*[\"']?$"
ASSIGNED = r"[=:]\s*[\"']?$"
FIXED_FORMAT = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abp]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9]{20,})$"
ODD_PATH = r"(?i)(^|/)(test|tests|example|examples|sample|docs?)/"
CONFIG_PATH = r"(?i)(\.(env|ini|cfg|conf|ya?ml|toml|properties)|config[^/]*)$"
MARK = "<SECRET>"

#: Bound of what the forest is fitted on.
LABELLED_FINDINGS = 20_000
#: Words of candidates that are broadcast.
FEW_WORDS = 200_000

FEATURES = (
    "n_chars", "n_transitions", "transition_rate", "digit_rate", "upper_rate", "distinct_rate", "is_hex", "coverage",
    "odd_path", "config_path", "named", "assigned", "quoted", "word_before",
)


def findings(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """(id, path, nth, start, candidate, before, after): one row per candidate; ``nth`` counts the matches of the text."""
    path = df[path_col].cast("string") if path_col else F.lit(None).cast("string")
    rows = df.select(df[id_col].alias("id"), path.alias("path"), text_or_empty(text_col).alias("text"))
    rows = rows.where(F.rlike("text", F.lit(CANDIDATE)))
    cut = rows.select("id", "path", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"))
    each = cut.select("id", "path", F.posexplode(F.arrays_zip(
        F.col("found").alias("candidate"),
        F.transform("gaps", lambda g: F.struct(F.right(g, F.lit(48)).alias("before"), F.left(g, F.lit(16)).alias("after"), F.length(g).alias("n"))).alias("gap"),
        F.slice(F.transform("gaps", lambda g: F.left(g, F.lit(16))), F.lit(2), F.greatest(F.size("gaps") - 1, F.lit(0))).alias("next"),
    )).alias("nth", "x"))
    return each.where(F.col("x.candidate").isNotNull() & F.rlike("x.candidate", F.lit("[0-9]"))).select(
        "id", "path", "nth", F.col("x.candidate").alias("candidate"), F.col("x.gap.before").alias("before"), F.coalesce("x.next", F.lit("")).alias("after")
    )


def audited() -> Column:
    """The labelling rule: a fixed format, or a token of many kinds of characters that a secret's name is assigned."""
    many = F.size(F.array_distinct(F.split("candidate", ""))) >= 8
    return F.rlike("candidate", F.lit(FIXED_FORMAT)) | (F.rlike("before", F.lit(SECRET_NAME)) & many)


def runs(candidates: DataFrame) -> DataFrame:
    """(candidate, word): runs of letters of each distinct candidate."""
    return candidates.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), 0)).alias("word"))


def dictionary(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """Words of ``wanted`` that at least two texts hold; words of three and more letters, counted once a text over all texts.

    Few wanted words are looked up before counting; for many, counting combines before the shuffle.
    """
    words = F.explode(F.array_distinct(F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}]+", -1)))
    held = df.select(words.alias("word")).where(F.length("word") >= 3)
    count = lambda rows: rows.groupBy("word").count().where("count > 1").select("word")
    if wanted.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        return count(held.join(F.broadcast(wanted), "word", "left_semi"))
    return count(held).join(wanted, "word", "left_semi")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the features; coverage is worked out once per distinct candidate."""
    covered = runs(found).join(broadcast_if_small(words, 200_000), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    n = F.length("candidate").cast("double")
    rate = lambda pattern: F.length(F.regexp_replace("candidate", pattern, "")) / n
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "+/_=-", "#####")
    moves = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double") - 1
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.join(covered, "candidate", "left").select(
        *found.columns,
        n.alias("n_chars"), moves.alias("n_transitions"), (moves / n).alias("transition_rate"),
        rate("[^0-9]").alias("digit_rate"), rate("[^A-Z]").alias("upper_rate"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("distinct_rate"),
        flag(F.rlike("candidate", F.lit("^([0-9a-f]+|[0-9A-F]+)$"))).alias("is_hex"),
        F.coalesce(F.col("covered") / n, F.lit(0.0)).alias("coverage"),
        flag(F.rlike("path", F.lit(ODD_PATH))).alias("odd_path"), flag(F.rlike("path", F.lit(CONFIG_PATH))).alias("config_path"),
        flag(F.rlike("before", F.lit(SECRET_NAME))).alias("named"), flag(F.rlike("before", F.lit(ASSIGNED))).alias("assigned"),
        flag(F.rlike("before", F.lit("[\"']$")) & F.rlike("after", F.lit("^[\"']"))).alias("quoted"),
        flag(F.rlike("before", F.lit(r"\p{L}\s+$"))).alias("word_before"),
    )


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None,
                labelled: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(id, nth, candidate, before, after, probability, secret) for every finding.

    ``labelled`` has (candidate, before, after, path, is_secret); without it the audited sample is used.
    """
    found = staged(findings(df, id_col, text_col, path_col), "findings")
    candidates = found.select("candidate")
    if labelled is not None:
        candidates = candidates.unionByName(labelled.select("candidate"))
    wanted = staged(runs(candidates).select("word").distinct(), "wanted-words")
    words = staged(dictionary(df, text_col, wanted), "dictionary")
    scored = described(found, words)
    if labelled is None:
        fit_on = scored.withColumn("is_secret", audited()).dropDuplicates(["candidate"])
    else:
        known = labelled.select("candidate", "before", "after", F.col("path").cast("string").alias("path"), "is_secret")
        fit_on = described(known, words)
    by_side = lambda s: fit_on.where(F.col("is_secret") == s).orderBy(F.xxhash64("candidate", "before")).limit(LABELLED_FINDINGS // 2)
    fit_on = staged(by_side(True).unionByName(by_side(False)).select(*FEATURES, F.col("is_secret").cast("double").alias("label")), "labelled")
    if fit_on.select("label").distinct().count() < 2:
        out = scored.withColumn("probability", audited().cast("double"))
    else:
        forest = RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", numTrees=24, maxDepth=6, seed=seed)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), forest]).fit(fit_on)
        out = model.transform(scored).withColumn("probability", vector_to_array("_prob")[1])
    return out.select(
        F.col("id").alias(id_col), "nth", "candidate", "before", "after",
        F.round("probability", 9).alias("probability"), (F.col("probability") >= 0.5).alias("secret"),
    )


def redact(df: DataFrame, id_col: str, text_col: str, secrets: DataFrame, mark: str = MARK) -> DataFrame:
    """The rows of ``df``, whose secrets are replaced by ``mark`` in ``text_col``; the other columns stay."""
    hits = secrets.where("secret").groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("nth").alias("_nth"))
    text = F.col(text_col)
    found, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), 0), F.split(text, CANDIDATE, -1)
    shown = F.transform(found, lambda c, k: F.when(F.array_contains("_nth", k), F.lit(mark)).otherwise(c))
    woven = F.array_join(F.zip_with(gaps, shown, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    joined = df.join(broadcast_if_small(hits), F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.select(*(F.when(F.col("_nth").isNull(), F.col(c)).otherwise(woven).alias(c) if c == text_col else F.col(c) for c in df.columns))
