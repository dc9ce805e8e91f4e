"""The named queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import current_functions, latest, table
from . import leakage, mixing, neardup, percentiles, subjects, terms

GROUP = ["metric", "label", "func_id"]


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Value counts per group and day, the state to which further days are added."""
    calls = table(spark, folder, "execute_result").select("probe_id", "label", "func_id", F.col("run_ts").cast("date").alias("day"), "elapsed_us")
    solver = table(spark, folder, "constraint_timing").select("timing_id", "label", F.col("run_day").try_cast("date").alias("day"), "eval_ms")
    calls = percentiles.measurements(calls, "probe_id", ["label", "func_id"], "day", "elapsed_us").withColumn("metric", F.lit("elapsed_us"))
    solver = percentiles.measurements(solver, "timing_id", ["label"], "day", "eval_ms").withColumn("metric", F.lit("eval_ms")).withColumn("func_id", F.lit(None).cast("string"))
    both = percentiles.value_counts(calls, GROUP).unionByName(percentiles.value_counts(solver, GROUP))
    return both


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of call and solver times per group, exactly."""
    return percentiles.percentiles(p3_counts(spark, folder), GROUP)


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return current_functions(spark, folder, ["pseudocode"]).filter("pseudocode is not null")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of functions whose current bodies are similar."""
    members, pairs = neardup.near_duplicates(_bodies(spark, folder), "fn_id", "pseudocode", n=3, threshold=0.6, least=20)
    return neardup.all_pairs(members, pairs).select(F.col("a").alias("fn_id_a"), F.col("b").alias("fn_id_b"))


def _with_classes(texts: DataFrame, key: str, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every text with its class and the class's number of similar classes; a text without a partner is a class of its own."""
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    linked = members.join(ends, "rep", "left").select(F.col("key").alias(key), F.col("rep").alias("class_id"), "n_links")
    return texts.select(key).join(linked, key, "left").select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each function that has a body, with the class of equal bodies and its number of similar classes."""
    bodies = _bodies(spark, folder)
    return _with_classes(bodies, "fn_id", *neardup.near_duplicates(bodies, "fn_id", "pseudocode", n=3, threshold=0.6, least=20))


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its class of equal texts and the number of classes that are near copies (five words, 0.8)."""
    texts = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("text"))
    return _with_classes(texts, "doc_id", *neardup.near_duplicates(texts, "doc_id", "text", token=r"\w+"))


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every word in function names and of every behaviour class, with marks."""
    names = current_functions(spark, folder, ["name"])
    name_terms = names.select(F.col("fn_id").alias("record"), F.explode(terms.name_words("name")).alias("term"), F.lit("name").alias("field_name"))
    classes = latest(table(spark, folder, "classify_result"), ["cls_id"], "classified_ts", ["func_class"])
    classes = classes.select(F.col("cls_id").alias("record"), F.lower(F.regexp_replace("func_class", r"^\s+|\s+$", "")).alias("term"), F.lit("func_class").alias("field_name")).filter("term != ''")
    counted = terms.term_counts(name_terms.unionByName(classes), ["field_name"], gathered=True)
    totals = names.agg(F.count("*").alias("total")).withColumn("field_name", F.lit("name")).unionByName(classes.agg(F.count("*").alias("total")).withColumn("field_name", F.lit("func_class")))
    return terms.marked(counted, totals, ["field_name"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The marked terms."""
    return p6_terms(spark, folder).filter("mark is not null").select("field_name", "term", "mark")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items they hold."""
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each evaluation item with the number of documents that hold it."""
    items = table(spark, folder, "eval_item").select("item_id", "suite")
    return items.join(p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs")), "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").withColumn("source", mixing.source_name(F.col("source")))
    targets = table(spark, folder, "mix_target").withColumn("source", mixing.source_name(F.col("source")))
    return mixing.mixture(mixing.token_sizes(documents, ["doc_id", "source"], "text"), targets)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each plan's mixture with their number of copies."""
    return _mixture(spark, folder)[0]


def p8_order(spark: SparkSession, folder: str) -> DataFrame:
    """The mixtures written out: block and position of every copy of a text."""
    return mixing.ordered(_mixture(spark, folder)[0])


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of each plan and source."""
    return _mixture(spark, folder)[1]


def _subjects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return subjects.subject_areas(table(spark, folder, "documents"), table(spark, folder, "subject_area"), table(spark, folder, "subject_label"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The areas of each document."""
    return _subjects(spark, folder)[0].select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each area, and their share of all documents; documents of two areas count for both."""
    total = table(spark, folder, "documents").agg(F.count("*").alias("n_all"))
    areas = _subjects(spark, folder)[0].groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("statements").alias("n_statements"))
    return areas.crossJoin(F.broadcast(total)).select("subject", "n_documents", "n_statements", (F.col("n_documents") / F.col("n_all")).alias("share"))


def p9_functions(spark: SparkSession, folder: str) -> DataFrame:
    """What the latent model learned about each labelling function."""
    return _subjects(spark, folder)[1]


QUERIES = {
    "p3_percentiles": p3_percentiles, "p3_counts": p3_counts, "p5_found": p5_found, "p5_classes": p5_classes, "p5_documents": p5_documents, "p6_found": p6_found, "p6_terms": p6_terms,
    "p7_found": p7_found, "p7_items": p7_items, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_order": p8_order,
    "p9_found": p9_found, "p9_composition": p9_composition, "p9_functions": p9_functions,
}
