"""The registered queries: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations


from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import Observation
from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.functions import banners as B
from editlift.functions import labels as L
from editlift.functions import markup as M
from editlift.functions import probability as P
from editlift.functions import titles as T
from editlift.functions.rows import unnest
from editlift.ml.linear import linear_scorer
from editlift.ml.ordinal import SequentialOrdinal, as_scorer
from editlift.ml.projection import ModelProjection
from editlift.ml.trees import CompiledScorer
from editlift.ml.selection import multiclass_model, quality_model, random_search, stratified_folds, stratified_split
from editlift.operators import assessment, backlog, batches, cleantext, edits, evaluation, lookup, spans, talk, usage
from editlift.operators.features import FEATURES, MODEL_COLUMNS, RAW_COLUMNS, featurize, model_projection
from editlift.plans import lifecycle
from editlift.session import reliable_checkpoint, scratch_path
from editlift.sources import dump, readers, schemas, sinks

K = len(L.CLASSES)
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, fx.REVISIONS)


def notices(spark: SparkSession, sf: str) -> DataFrame:
    return backlog.flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return featurize(revisions(spark, sf), "wikitext", notices(spark, sf))


def featurized_table(spark: SparkSession, sf: str) -> DataFrame:
    """Featurized revisions with every declared column, text columns last."""
    rows = features(spark, sf).select(
        F.col("rev_id").alias("revid"),
        F.col("page_id").alias("pageid"),
        F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"),
        "wp10", "wikitext", *FEATURES, "tables",
    )
    declared = spark.createDataFrame([], schemas.FEATURIZED_WITH_TEXT)
    return readers.concat(declared, rows)


# --- scans, sources, sinks ------------------------------------------------


@query
def s1_ndjson_scan(spark, sf):
    path = scratch_path(spark, "ndjson")
    sinks.write_ndjson(revisions(spark, sf).withColumnRenamed("rev_id", "revid"), path, compression="none")
    return readers.read_ndjson(spark, path).select("revid", "wp10", F.length("wikitext").alias("n_chars"))


@query
def s1_tolerant_scan(spark, sf):
    """Every tenth line cut short: the other lines read, the cut ones counted apart."""
    path = scratch_path(spark, "ndjson-broken")
    lines = revisions(spark, sf).select(F.to_json(F.struct(F.col("rev_id").alias("revid"), "wp10", "wikitext")).alias("j"), "rev_id")
    cut = F.when(F.col("rev_id") % 10 == 0, F.expr("substring(j, 1, length(j) - 2)")).otherwise(F.col("j"))
    lines.select(cut.alias("value")).write.text(path)
    observation = Observation("tolerant-scan")
    good, _ = readers.split_corrupt(readers.read_ndjson_tolerant(spark, path), observation)
    return good.select("revid", "wp10", F.length("wikitext").alias("n_chars"))


@query
def s2_ndjson_sink(spark, sf):
    path = scratch_path(spark, "ndjson-gz")
    sinks.write_ndjson(revisions(spark, sf), path)
    rows = readers.read_ndjson(spark, path, "rev_id BIGINT, lang STRING, wikitext STRING")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("wikitext").cast("long")).alias("n_chars")
    )


@query
def s3_labeled_without_text(spark, sf):
    path = scratch_path(spark, "labeled-one")
    sinks.write_ndjson(featurized_table(spark, sf), path)
    return readers.read_labeled_one(spark, path).select("revid", "wp10", "words", "headings", "ref", "coordinates")


@query
def s4_labeled_folder(spark, sf):
    path = scratch_path(spark, "labeled")
    sinks.write_by_label(featurized_table(spark, sf), path)
    return readers.read_labeled(spark, path).groupBy("wp10", "code").agg(
        F.count("*").alias("n"), F.sum("templates").alias("templates")
    )


@query
def s5_csv_features(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(featurized_table(spark, sf).drop("wikitext", "text"), path)
    return readers.read_featurized_csv(spark, path).select(
        "revid", "wp10", "code", "words", "images", "backlog_accuracy_templates"
    )


@query
def s6_csv_comment(spark, sf):
    path = scratch_path(spark, "csv-comment")
    counts = assessment.class_frequency(revisions(spark, sf))
    lines = counts.select(
        F.concat_ws("\n", F.concat(F.lit("# class "), "wp10"), F.concat_ws(",", "wp10", "articles")).alias("value")
    )
    lines.write.text(path)
    return readers.read_class_counts(spark, path, header=False)


@query
def s7_split_by_label(spark, sf):
    path = scratch_path(spark, "by-label")
    rows = features(spark, sf).select("rev_id", "wp10", "ref")
    sinks.write_by_label(rows.where("rev_id % 2 = 0"), path, fmt="parquet")
    sinks.write_by_label(rows.where("rev_id % 2 = 1"), path, fmt="parquet", mode="append")
    return spark.read.parquet(path).select("rev_id", F.col("wp10").cast("string").alias("wp10"), "ref")


@query
def s7_replace_classes(spark, sf):
    path = scratch_path(spark, "by-label")
    rows = features(spark, sf).select("rev_id", "wp10", "ref")
    sinks.write_by_label(rows, path, fmt="parquet")
    # A second run of three classes replaces those three folders alone.
    again = rows.where("rev_id % 4 = 0").withColumn("ref", F.col("ref") + 100)
    sinks.write_by_label(again, path, fmt="parquet", mode="replace")
    return spark.read.parquet(path).select("rev_id", F.col("wp10").cast("string").alias("wp10"), "ref")


@query
def s8_refuse_existing(spark, sf):
    path = scratch_path(spark, "once")
    rows = revisions(spark, sf).select("rev_id", "wp10")
    sinks.write_ndjson(rows, path)
    refused = False
    try:
        sinks.write_ndjson(rows, path)
    except Exception as error:  # the session's own error type
        refused = "ALREADY_EXISTS" in str(error)
    return readers.read_ndjson(spark, path, schemas.LABELED_IDS).withColumn("refused", F.lit(refused))


@query
def s9_catalogue_file(spark, sf):
    path = scratch_path(spark, "catalogue")
    sinks.write_catalogue(_catalogue(spark, sf), path)
    return backlog.unnest_catalogue(readers.read_catalogue(spark, path, whole_file=False))


# --- projection, filter, flattening ----------------------------------------


def _dump(spark, sf):
    return revisions(spark, sf).select(
        F.col("rev_id").alias("id"),
        F.struct(
            F.col("page_id").alias("id"),
            F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"),
            F.lit(0).alias("namespace"),
            F.when(F.col("rev_id") % 10 == 9, F.lit("Title 0")).alias("redirect"),
        ).alias("page"),
        F.when(
            F.col("rev_id") % 4 > 0,
            F.struct((F.col("rev_id") % 7).alias("id"), F.col("source").alias("text")),
        ).alias("user"),
        F.struct(
            (F.col("rev_id") % 5 == 0).alias("text"), F.lit(False).alias("comment"), F.lit(False).alias("user")
        ).alias("deleted"),
        F.when(F.col("rev_id") % 3 > 0, F.col("lang")).alias("comment"),
    )


@query
def d1_flatten_revision(spark, sf):
    return dump.flatten_revisions(_dump(spark, sf))


@query
def d2_first_pages(spark, sf):
    return dump.first_pages(revisions(spark, sf), 10).select("rev_id", "page_id")


@query
def d3_page_revisions(spark, sf):
    rev = revisions(spark, sf)
    text = F.struct(F.struct(F.col("wikitext").alias("*")).alias("main"))
    gone = F.struct(F.struct(F.lit(None).cast("string").alias("*")).alias("main"))
    pages = rev.select(
        F.col("page_id").alias("pageid"),
        F.lit(0).alias("ns"),
        F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"),
        F.array(
            F.struct(F.col("rev_id").alias("revid"), text.alias("slots")),
            F.struct((-F.col("rev_id") - 1).alias("revid"), gone.alias("slots")),
        ).alias("revisions"),
    )
    return dump.page_revisions(pages).select("revid", "pageid", "ns", "title", F.length("wikitext").alias("n_chars"))


@query
def d4_label_join(spark, sf):
    labels = fx.load(spark, sf, fx.LABELS)
    return dump.attach_labels(revisions(spark, sf), labels, rev="rev_id").select("rev_id", "page_id", "wp10")


def _mixed_labels(spark, sf):
    wp10 = F.when(F.col("rev_id") % 13 == 0, F.lit("List")).otherwise(F.col("wp10"))
    return revisions(spark, sf).select("rev_id", wp10.alias("wp10"))


@query
def d5_label_code(spark, sf):
    return _mixed_labels(spark, sf).withColumn("code", L.label_code(F.col("wp10")))


@query
def d6_code_label(spark, sf):
    rows = fx.load(spark, sf, fx.PREDICTIONS)
    return rows.select(
        "l_orderkey", "l_linenumber", L.code_label(F.col("actual")).alias("actual"), L.code_label(F.col("pred")).alias("pred")
    )


@query
def d7_strict_labels(spark, sf):
    return revisions(spark, sf).select("rev_id", L.known_label(F.col("wp10")).alias("wp10"))


@query
def d8_keep_classes(spark, sf):
    return assessment.keep_classes(assessment.class_frequency(_mixed_labels(spark, sf)))


@query
def d9_model_columns(spark, sf):
    rows = model_projection(features(spark, sf), "rev_id")
    return rows.select("rev_id", *[F.round(c, 6).alias(c) for c in MODEL_COLUMNS])


@query
def d11_next_class(spark, sf):
    return _mixed_labels(spark, sf).withColumn("next_class", L.next_label(F.col("wp10")))


@query
def d12_id_batches(spark, sf):
    return batches.id_batches(fx.load(spark, sf, "SELECT event_id FROM events"), "event_id", 50)


@query
def d13_page_url(spark, sf):
    title = F.concat(F.lit("Page "), F.col("rev_id").cast("string"), F.lit(" & more"))
    revid = F.when(F.col("rev_id") % 2 == 0, F.col("rev_id"))
    return revisions(spark, sf).select("rev_id", T.page_url(title, F.col("lang"), revid).alias("url"))


# --- joins -------------------------------------------------------------------


@query
def j1_backlog_hits(spark, sf):
    rows = revisions(spark, sf).select("rev_id", M.clean(F.col("wikitext")).alias("_clean"))
    named = rows.select("rev_id", M.template_names(F.col("_clean")).alias("templates"))
    return backlog.backlog_hits(named, notices(spark, sf)).select("rev_id", "pos", "name", "section")


@query
def j2_redirects(spark, sf):
    requests = fx.load(spark, sf, fx.REQUESTS)
    return lookup.follow_redirects(requests, fx.load(spark, sf, fx.REDIRECTS))


@query
def j2_redirect_chains(spark, sf):
    closed = lookup.redirect_closure(fx.load(spark, sf, fx.REDIRECT_CHAINS))
    titles = revisions(spark, sf).select(
        "rev_id", F.concat(F.lit("Title "), F.col("rev_id").cast("string")).alias("title")
    )
    return lookup.follow_redirects(titles, closed)


@query
def j3_page_lookup(spark, sf):
    found = lookup.lookup_pages(
        fx.load(spark, sf, fx.REQUESTS), fx.load(spark, sf, fx.PAGES), fx.load(spark, sf, fx.REDIRECTS)
    )
    return found.select(
        "request_id", "asked", "title", "revid", "pageid", "timestamp", "talk_page", "found",
        F.length("content").alias("n_chars"),
    )


@query
def j3_not_found(spark, sf):
    return lookup.not_found(
        fx.load(spark, sf, fx.REQUESTS), fx.load(spark, sf, fx.PAGES), fx.load(spark, sf, fx.REDIRECTS)
    )


@query
def j4_talk_page(spark, sf):
    talk_pages = fx.load(
        spark, sf, "SELECT concat('Talk:Title ', CAST(p_partkey AS STRING)) AS talk_title, p_name AS note FROM part"
    )
    pages = fx.load(spark, sf, fx.PAGES).select("revid", "title")
    return lookup.with_talk_page(pages, talk_pages).select("revid", "title", "talk_title", "note")


@query
def j5_edit_variants(spark, sf):
    return edits.edit_variants(features(spark, sf), "rev_id").select(
        "rev_id", "edit_no", "edit", *[F.col(c).cast("int").alias(c) for c in RAW_COLUMNS]
    )


def _tokens(spark, sf):
    rows = fx.load(spark, sf, fx.SPANS)
    return rows.select("doc_id", "tok_start"), rows.select("doc_id", "ref_pos")


@query
def j6_flagged_tokens(spark, sf):
    return spans.flag_tokens(*_tokens(spark, sf))


@query
def j7_reference_tokens(spark, sf):
    return spans.token_of_reference(*_tokens(spark, sf))


def _text_with_references(spark, sf):
    text, references = cleantext.text_and_references(revisions(spark, sf), "rev_id")
    return spans.tokens_of(text, "rev_id"), references.withColumnRenamed("offset", "ref_pos")


@query
def j6_text_tokens(spark, sf):
    return spans.tokens_of(cleantext.clean_text(revisions(spark, sf), "rev_id"), "rev_id")


@query
def j6_flagged_text(spark, sf):
    return spans.flag_tokens(*_text_with_references(spark, sf), key="rev_id")


@query
def j7_text_references(spark, sf):
    return spans.token_of_reference(*_text_with_references(spark, sf), key="rev_id")


@query
def j8_template_pages(spark, sf):
    aliases = fx.load(spark, sf, fx.BACKLOG)
    return usage.template_index(revisions(spark, sf), aliases, key="page_id")


@query
def j9_category_members(spark, sf):
    pages = revisions(spark, sf).withColumn("title", F.concat(F.lit("Title "), F.col("rev_id").cast("string")))
    return usage.category_members(pages, fx.load(spark, sf, fx.REDIRECTS), key="rev_id")


# --- aggregation ---------------------------------------------------------------


@query
def a1_template_counts(spark, sf):
    return usage.template_counts(revisions(spark, sf))


@query
def a2_link_counts(spark, sf):
    return usage.link_counts(revisions(spark, sf))


@query
def a3_backlog_sections(spark, sf):
    columns = [c for n in backlog.COLUMN_OF.values() for c in (n, f"{n}_templates")]
    return features(spark, sf).select("rev_id", *columns)


@query
def a4_class_frequency(spark, sf):
    return assessment.class_frequency(revisions(spark, sf))


@query
def a5_class_share(spark, sf):
    shares = assessment.class_share(assessment.class_frequency(revisions(spark, sf)))
    return shares.withColumn("pct", F.round("pct", 6))


@query
def a6_share_between(spark, sf):
    counts = assessment.class_frequency(revisions(spark, sf))
    return assessment.share_between(counts, "Start", "Stub").select(F.round("pct", 6).alias("pct"))


def _predictions(spark, sf):
    return fx.load(spark, sf, fx.PREDICTIONS)


def _round(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def a7_confusion(spark, sf):
    return _round(evaluation.confusion(_predictions(spark, sf)), "p", "p_actual")


@query
def a8_confusion_matrix(spark, sf):
    return _round(evaluation.confusion_matrix(_predictions(spark, sf)), *[f"p{k}" for k in range(K)])


@query
def a9_exact_hit_rate(spark, sf):
    return _round(evaluation.hit_rates(_predictions(spark, sf)).select("exact_hit"), "exact_hit")


@query
def a10_ordinal_hit_rate(spark, sf):
    return _round(evaluation.hit_rates(_predictions(spark, sf)).select("ordinal_hit"), "ordinal_hit")


@query
def a11_ordinal_recall_precision(spark, sf):
    rows = _predictions(spark, sf)
    out = evaluation.recall(rows).select("class_code", "recall").join(
        evaluation.precision(rows).select("class_code", "precision"), "class_code"
    )
    return _round(out, "recall", "precision")


@query
def a12_exact_recall_precision(spark, sf):
    rows = _predictions(spark, sf)
    out = evaluation.recall(rows).select("class_code", "recall_exact").join(
        evaluation.precision(rows).select("class_code", "precision_exact"), "class_code"
    )
    return _round(out, "recall_exact", "precision_exact")


@query
def a13_macro_f1(spark, sf):
    out = evaluation.macro_scores(_predictions(spark, sf))
    return _round(out, *out.columns)


@query
def a14_class_report(spark, sf):
    out = evaluation.class_report(_predictions(spark, sf))
    return _round(out, "precision", "precision_exact", "recall", "recall_exact")


@query
def a15_ordinal_score(spark, sf):
    return _round(evaluation.ordinal_score(_predictions(spark, sf)), "ordinal_score")


def _chain(spark, sf):
    rows = fx.load(spark, sf, fx.COND_PROBS)
    return rows.select("rev_id", P.chain_array([F.col(f"q{k}") for k in range(K - 1)]).alias("prob"))


@query
def a16_log_loss(spark, sf):
    rows = _chain(spark, sf).withColumn("actual", (F.col("rev_id") % 6).cast("int"))
    return _round(evaluation.log_loss(rows), "log_loss")


@query
def a17_quality_by_category(spark, sf):
    return talk.quality_by_category(fx.load(spark, sf, fx.CATEGORIES))


@query
def a18_quality_by_banner(spark, sf):
    return talk.quality_by_banner(talk.project_map(fx.load(spark, sf, fx.TALK)))


@query
def a19_project_map(spark, sf):
    return talk.project_map(fx.load(spark, sf, fx.TALK))


# --- windows, sort, top-k, set operations ---------------------------------------


@query
def w1_group_total(spark, sf):
    counts = evaluation.confusion_counts(_predictions(spark, sf))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("actual")))


@query
def w2_running_class_sum(spark, sf):
    sums = P.cumulative(F.col("prob"), K)
    return _chain(spark, sf).select("rev_id", *[F.round(s, 6).alias(f"c{k}") for k, s in enumerate(sums)])


@query
def w3_section_offsets(spark, sf):
    rows = cleantext.sections(revisions(spark, sf), "rev_id").withColumn("length", F.length("section"))
    out = spans.running_starts(rows.select("rev_id", "sec_no", "length"), "rev_id", length="length", pos="sec_no")
    return out.select("rev_id", "sec_no", "length", "start")


def _suggested(spark, sf):
    scored = edits.score_revisions(features(spark, sf), linear_scorer)
    return edits.suggest_edits(scored, linear_scorer)


@query
def w4_ranked_edits(spark, sf):
    return edits.explode_suggestions(_suggested(spark, sf), "rev_id")


@query
def w5_shown_edits(spark, sf):
    rows = _suggested(spark, sf).select("rev_id", edits.shown_edits(F.col("edits")).alias("edits"))
    return unnest(rows, "rev_id", array="edits", value="_e").select("rev_id", "_e.edit", "_e.gain_pct")


@query
def w6_concat(spark, sf):
    rows = revisions(spark, sf)
    even = rows.where("rev_id % 2 = 0").select("rev_id", "wp10", "lang")
    odd = rows.where("rev_id % 2 = 1").select("wp10", "rev_id", "source")
    return readers.concat(even, odd)


@query
def w7_classes_best_first(spark, sf):
    rows = _chain(spark, sf).select("rev_id", edits.shown_classes(F.col("prob")).alias("classes"))
    return unnest(rows, "rev_id", array="classes", value="_c").select("rev_id", "pos", "_c.*")


# --- markup features -------------------------------------------------------------


def _feature(name, *columns):
    def run(spark, sf):
        return features(spark, sf).select("rev_id", *(columns or (name.split("_", 1)[1],)))

    run.__name__ = name
    return query(run)


_feature("f1_words")
_feature("f2_headings")
_feature("f3_sub_headings")
_feature("f4_images")
_feature("f5_categories")
_feature("f6_wikilinks")
_feature("f7_external_links")
_feature("f8_templates")
_feature("f10_name_matches", "main_templates", "cite_templates", "infoboxes")
_feature("f11_ref")
_feature("f12_smartlists", "smartlists", "tables")
_feature("f13_coordinates")
_feature("f14_plain_text", "text")
_feature("f15_features", "page_id", "wp10", *[c for c in FEATURES if c != "text"])


@query
def f3_headings_of_level(spark, sf):
    rows = revisions(spark, sf).select("rev_id", M.clean(F.col("wikitext")).alias("_clean"))
    return rows.select("rev_id", *[M.num_headings(F.col("_clean"), k).alias(f"level{k}") for k in (2, 3, 4)])


@query
def f9_template_keys(spark, sf):
    rows = revisions(spark, sf).select("rev_id", M.clean(F.col("wikitext")).alias("_clean"))
    named = unnest(
        rows.select("rev_id", M.template_names(F.col("_clean")).alias("_all")), "rev_id", array="_all", value="_n"
    )
    return named.groupBy(M.template_key(F.col("_n")).alias("key")).agg(F.count("*").alias("n"))


@query
def f16_references(spark, sf):
    found = cleantext.pieces(revisions(spark, sf), "rev_id").where(F.col("kind") == "ref")
    return found.groupBy("rev_id").agg(F.count("*").alias("n"))


@query
def f17_image_links(spark, sf):
    return usage.image_links(revisions(spark, sf))


@query
def f17_category_links(spark, sf):
    return usage.category_links(revisions(spark, sf))


# --- plain text with spans ----------------------------------------------------------


@query
def t1_sections(spark, sf):
    rows = cleantext.sections(revisions(spark, sf), "rev_id")
    return rows.select("rev_id", "sec_no", "heading", F.length("section").alias("n_chars"))


@query
def t2_drop_sections(spark, sf):
    rows = cleantext.drop_sections(cleantext.sections(revisions(spark, sf), "rev_id"), ("early", "references"))
    return rows.select("rev_id", "sec_no", "heading")


@query
def t3_pieces(spark, sf):
    rows = cleantext.pieces(revisions(spark, sf), "rev_id")
    return rows.where("kind <> 'text'").groupBy("rev_id", "kind").agg(F.count("*").alias("n"))


@query
def t3_deep_pieces(spark, sf):
    rows = cleantext.pieces(fx.load(spark, sf, fx.NESTED), "rev_id").where("kind <> 'text'")
    return rows.groupBy("rev_id", "kind").agg(F.count("*").alias("n"), F.max(F.length("raw")).cast("long").alias("n_chars"))


@query
def t4_tag_rules(spark, sf):
    rev = revisions(spark, sf).withColumn(
        "wikitext", F.concat(F.lit("<b>x</b><poem>y</poem><gallery>z</gallery>"), F.col("wikitext"))
    )
    rules = cleantext.Rules(tags_keep=("poem",), tags_remove=("gallery",))
    rows = cleantext.pieces(rev, "rev_id", rules=rules).where("kind = 'tag'")
    return rows.select("rev_id", "pos", "name", "piece")


@query
def t5_template_rules(spark, sf):
    rules = cleantext.Rules(templates_keep=("cite",), templates_remove=("infobox",))
    rows = cleantext.pieces(revisions(spark, sf), "rev_id", rules=rules).where("kind = 'template'")
    return rows.groupBy("rev_id", "name", "piece").agg(F.count("*").alias("n"))


@query
def t6_template_spans(spark, sf):
    return cleantext.template_spans(revisions(spark, sf), "rev_id")


@query
def t6_reference_offsets(spark, sf):
    return cleantext.reference_offsets(revisions(spark, sf), "rev_id").select("rev_id", "offset")


@query
def t7_clean_text(spark, sf):
    return cleantext.clean_text(revisions(spark, sf), "rev_id")


@query
def t6_deep_template_spans(spark, sf):
    return cleantext.template_spans(fx.load(spark, sf, fx.NESTED), "rev_id")


@query
def t7_deep_text(spark, sf):
    return cleantext.clean_text(fx.load(spark, sf, fx.NESTED), "rev_id")


@query
def t8_node_rules(spark, sf):
    rows = cleantext.pieces(revisions(spark, sf), "rev_id").where("kind <> 'text'")
    return rows.select("rev_id", "kind", "name", "piece").distinct()


# --- catalogues and talk pages ---------------------------------------------------------


def _catalogue(spark, sf):
    return backlog.build_catalogue(fx.load(spark, sf, fx.CATALOGUE), fx.load(spark, sf, fx.TEMPLATE_REDIRECTS))


@query
def b1_flatten_catalogue(spark, sf):
    return backlog.flatten_catalogue(_catalogue(spark, sf))


@query
def b2_excluded_category(spark, sf):
    return backlog.flatten_catalogue(_catalogue(spark, sf), excluded=("Category 1", "Category 2"))


@query
def b3_build_catalogue(spark, sf):
    return _catalogue(spark, sf)


@query
def b4_bare_names(spark, sf):
    rows = fx.load(spark, sf, fx.TEMPLATE_REDIRECTS)
    return rows.select("from_title", T.bare_template_name(F.col("from_title")).alias("name"))


@query
def b5_banner_class(spark, sf):
    return talk.parse_banners(fx.load(spark, sf, fx.TALK)).select("page_id", "seq", "class")


@query
def b6_banner_importance(spark, sf):
    return talk.parse_banners(fx.load(spark, sf, fx.TALK)).select("page_id", "seq", "importance")


@query
def b7_banner_parameters(spark, sf):
    banner = F.col("banner")
    return fx.load(spark, sf, fx.TALK).select(
        "seq", B.banner_name(banner).alias("name"), B.parameter(banner, "class").alias("class"),
        B.parameter(banner, "importance").alias("importance"), B.parameter(banner, "listas").alias("listas"),
    )


# --- edits --------------------------------------------------------------------------


def _variants(spark, sf, kind):
    names = [e.name for e in edits.EDITS if e.kind == kind]
    changed = sorted({e.column for e in edits.EDITS if e.kind == kind} | {"words"})
    rows = edits.edit_variants(features(spark, sf), "rev_id", with_unchanged=False)
    return rows.where(F.col("edit").isin(*names)).select(
        "rev_id", "edit", *[F.col(c).cast("int").alias(c) for c in changed]
    )


@query
def e1_edits_per_catalogue(spark, sf):
    rows = edits.edit_variants(features(spark, sf), "rev_id")
    return rows.groupBy("edit_no", "edit").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query
def e2_count_edits(spark, sf):
    return _variants(spark, sf, "count")


@query
def e3_word_edits(spark, sf):
    return _variants(spark, sf, "words")


@query
def e4_both_edits(spark, sf):
    return _variants(spark, sf, "both")


@query
def e5_flag_edits(spark, sf):
    return _variants(spark, sf, "flag")


@query
def e6_scored_variants(spark, sf):
    rows = edits.score_edits(features(spark, sf), linear_scorer, "rev_id")
    return rows.select("rev_id", "edit_no", F.round("score", 6).alias("score"), F.round("gain", 6).alias("gain"))


@query
def e6_top_edit(spark, sf):
    return edits.explode_suggestions(_suggested(spark, sf), "rev_id").where("rank = 1")


@query
def e6_fitted_model_edits(spark, sf):
    rows = _train(spark, sf)
    model = quality_model(LogisticRegression(maxIter=20, regParam=0.01)).fit(rows.select("code", *RAW_COLUMNS))
    return edits.rank_edits(edits.score_edits(rows, as_scorer(model), "rev_id"), "rev_id")


@query
def e6_compiled_tree_edits(spark, sf):
    """The boosted chain (100 rounds of depth 3) compiled to expressions: every variant scored in its row."""
    rows = _train(spark, sf)
    model = quality_model().fit(rows.select("code", *RAW_COLUMNS))
    return edits.rank_edits(edits.score_edits(rows, CompiledScorer(model), "rev_id"), "rev_id")


@query
def e7_page_results(spark, sf):
    out = lifecycle.answer_requests(
        fx.load(spark, sf, fx.REQUESTS), fx.load(spark, sf, fx.PAGES), fx.load(spark, sf, fx.REDIRECTS),
        notices(spark, sf), linear_scorer,
    )
    return out.select(
        "request_id", "asked", "title", "revid", "found", "best", "url",
        *[F.col("classes")[k]["pct"].alias(f"pct_{L.CLASSES[K - 1 - k].lower()}") for k in range(K)],
        F.size("edits").alias("n_edits"),
        F.try_element_at("edits", F.lit(1))["edit"].alias("first_edit"),
        F.try_element_at("edits", F.lit(1))["gain_pct"].alias("first_gain_pct"),
    )


@query
def p7_percent(spark, sf):
    rows = fx.load(spark, sf, "SELECT event_id, CAST(event_id % 400 AS DOUBLE) / CAST(800 AS DOUBLE) AS p FROM events")
    return rows.select("event_id", P.percent(F.col("p")).alias("pct"))


# --- model ----------------------------------------------------------------------------


def _train(spark, sf):
    """The narrow rows of the models, computed once: every pass of a learner, and scoring, would read the texts again."""
    rows = features(spark, sf).withColumn("code", L.label_code(F.col("wp10")))
    return reliable_checkpoint(rows.select("rev_id", "code", *RAW_COLUMNS))


def _probs(df):
    return df.select("rev_id", *[F.round(F.col("prob")[k], 6).alias(f"p{k}") for k in range(K)])


@query
def m1_split_counts(spark, sf):
    rows = stratified_split(_mixed_labels(spark, sf).withColumn("code", L.label_code(F.col("wp10"))))
    return rows.groupBy("code").agg(
        F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("n_train")
    )


@query
def m1_fold_counts(spark, sf):
    rows = stratified_folds(_mixed_labels(spark, sf).withColumn("code", L.label_code(F.col("wp10"))), k=5)
    return rows.groupBy("code", "fold").agg(F.count("*").alias("n"))


@query
def m2_sequential_trees(spark, sf):
    rows = _train(spark, sf)
    model = quality_model(GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=1)).fit(rows)
    return model.transform(rows).select("rev_id", "code", "prediction")


@query
def m2_sequential_logistic(spark, sf):
    rows = _train(spark, sf)
    model = quality_model(LogisticRegression(maxIter=20, regParam=0.01)).fit(rows)
    return model.transform(rows).select("rev_id", "code", "prediction")


@query
def m2_saturated_chain(spark, sf):
    """The chain fitted without penalty on a one-hot of five groups: its class probabilities are the
    class frequencies of each group, an exact answer the SQL states."""
    rows = revisions(spark, sf).select(F.col("rev_id") % 5, L.label_code(F.col("wp10")))
    rows = rows.toDF("grp", "code")
    onehot = array_to_vector(F.array(*[(F.col("grp") == g).cast("double") for g in range(5)]))
    learner = LogisticRegression(maxIter=500, regParam=0.0, fitIntercept=False, tol=1e-12, standardization=False)
    model = SequentialOrdinal(classifier=learner, featuresCol="onehot", labelCol="code").fit(rows.withColumn("onehot", onehot))
    probs = model.transform(rows.withColumn("onehot", onehot)).groupBy("grp").agg(F.first("prob").alias("prob"))
    return probs.select(F.col("grp").cast("long").alias("grp"), *[F.round(F.col("prob")[k], 4).alias(f"p{k}") for k in range(K)])


@query
def m3_chain_prob(spark, sf):
    return _probs(_chain(spark, sf))


@query
def m4_median_class(spark, sf):
    return _chain(spark, sf).select("rev_id", P.median_code(F.col("prob"), K).alias("code"))


@query
def m5_modal_class(spark, sf):
    return _chain(spark, sf).select("rev_id", P.modal_code(F.col("prob")).alias("code"))


@query
def m6_probability_output(spark, sf):
    rows = ModelProjection().transform(_train(spark, sf))
    chain = SequentialOrdinal(
        classifier=LogisticRegression(regParam=0.01), labelCol="code", output="probability"
    )
    return _probs(chain.fit(rows).transform(rows))


@query
def m7_persisted_model(spark, sf):
    rows = _train(spark, sf)
    path = scratch_path(spark, "model")
    quality_model(LogisticRegression(regParam=0.01)).fit(rows).save(path)
    return _probs(PipelineModel.load(path).transform(rows))


@query
def m8_random_search(spark, sf):
    rows = _train(spark, sf)
    search = random_search(rows)
    return search.bestModel.transform(rows).select("rev_id", "code", "prediction")


@query
def m9_multiclass(spark, sf):
    rows = _train(spark, sf)
    out = None
    for kind in ("forest", "logistic"):
        scored = multiclass_model(kind).fit(rows).transform(rows)
        probs = _probs(scored.select("rev_id", vector_to_array("probability").alias("prob"))).withColumn("kind", F.lit(kind))
        out = probs if out is None else out.unionByName(probs)
    return out


@query
def m10_expected_class(spark, sf):
    return _chain(spark, sf).select("rev_id", F.round(P.expected_code(F.col("prob"), K), 6).alias("score"))
