"""Ontology closures, groupings and hierarchical encoders, and names of ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_ids
from .numbering import cut


def parent_edges(ontology: DataFrame) -> DataFrame:
    """``child`` and ``parent`` for each parent of ``ontology_id``."""
    return ontology.select(F.col("ontology_id").alias("child"), F.explode("parents").alias("parent")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``child`` and ``ancestor`` for every way up, each pair once; pairs of a term with itself only in cycles.

    The paths double in length with each round, so the rounds grow with the logarithm of the depth; a
    cycle ends like anything else when no pair is new. Pairs are checkpointed after every round.
    """
    pairs = cut(edges.select("child", F.col("parent").alias("ancestor")).distinct())
    n = pairs.count()
    while True:
        up = pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("higher"))
        more = pairs.join(up, "ancestor").select("child", F.col("higher").alias("ancestor"))
        pairs = cut(pairs.union(more).distinct())
        if (m := pairs.count()) == n:
            return pairs
        n = m


def reached(edges: DataFrame, terms: DataFrame, up: bool = True) -> DataFrame:
    """``term`` and ``reached``: what lies above (or below) each of ``terms`` (term), each pair once; a term itself only in cycles.

    Only what the round before found anew meets the edges again, so rows grow with the answer, not with the ontology's closure.
    """
    near, far = ("child", "parent") if up else ("parent", "child")
    steps = cut(edges.select(F.col(near).alias("reached"), F.col(far).alias("__next")).distinct())
    new = cut(terms.select("term", F.col("term").alias("reached")).where(F.col("term").isNotNull()).distinct())
    every = None
    while every is None or not new.isEmpty():
        found = new.join(steps, "reached").select("term", F.col("__next").alias("reached")).distinct()
        new = cut(found.join(every, ["term", "reached"], "left_anti") if every is not None else found)
        every = cut(every.union(new)) if every is not None else new
    return every


def ancestors(edges: DataFrame, term: str) -> DataFrame:
    return reached(edges, edges.sparkSession.createDataFrame([(term,)], "term string")).select(F.col("reached").alias("ancestor"))


def descendants(edges: DataFrame, term: str) -> DataFrame:
    return reached(edges, edges.sparkSession.createDataFrame([(term,)], "term string"), up=False).select(F.col("reached").alias("descendant"))


def groupings(terms: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of used ``terms`` (term): ``ancestor`` and the sorted ``leafs`` below it; and the leafs, which are above no other."""
    used = pairs.join(terms.select(F.col("term").alias("child")), "child", "left_semi").where("child != ancestor")
    above = used.select(F.col("ancestor").alias("term")).distinct()
    leafs = terms.join(above, "term", "left_anti")
    below = used.join(leafs.select(F.col("term").alias("child")), "child", "left_semi")
    return below.groupBy("ancestor").agg(F.array_sort(F.collect_set("child")).alias("leafs")), leafs


def hierarchy_encoder(terms: DataFrame, pairs: DataFrame, unknown: str = "unknown") -> DataFrame:
    """``value`` and ``code``: leafs from 0 in order, then ancestors (those in the data first), unknown -1."""
    known = terms.where(F.col("term") != unknown)
    used = pairs.join(known.select(F.col("term").alias("child")), "child", "left_semi").where("child != ancestor")
    above = used.select(F.col("ancestor").alias("value")).distinct().withColumn("up", F.lit(1))
    seen = known.select(F.col("term").alias("value"), F.lit(0).alias("new"))
    every = seen.join(above, "value", "full").select("value", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("new", F.lit(1)).alias("new"))
    codes = every.select("value", (F.row_number().over(Window.orderBy("up", "new", "value")) - 1).alias("code"))
    return codes.unionByName(terms.sparkSession.createDataFrame([(unknown, -1)], "value string, code int"))


def coded_groupings(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """Groupings with codes in place of terms: a row for each ancestor and leaf below it."""
    long = groups.select("ancestor", F.explode("leafs").alias("leaf"))
    named = lambda name: codes.select(F.col("value").alias(name), F.col("code").alias(f"{name}_code"))
    return long.join(named("ancestor"), "ancestor").join(named("leaf"), "leaf").select("ancestor_code", "leaf_code")


def translate(ids: DataFrame, ontology: DataFrame, kind: str, column: str = "ids") -> DataFrame:
    """Add ``name``: the names of comma-joined ids, joined by commas; null if any id has none.

    Each distinct list is looked up once.
    """
    lists = ids.select(column).distinct().where(F.col(column).isNotNull())
    parts = lists.select(column, F.posexplode(split_ids(F.col(column))).alias("i", "ontology_id"))
    names = ontology.where(F.col("kind") == kind).groupBy("ontology_id").agg(F.min("name").alias("part"))
    by = parts.join(names, "ontology_id", "left").groupBy(column)
    found = by.agg(F.count_if(F.col("part").isNull()).alias("lacking"), F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"))
    named = found.select(F.col(column).alias("__ids"), F.when(F.col("lacking") == 0, F.array_join(F.transform("parts", lambda x: x["part"]), ",")).alias("name"))
    return ids.join(named, F.col(column) == F.col("__ids"), "left").drop("__ids")


#: Label types that :func:`translate_value` knows, with their registry.
TRANSLATED = {f"{k}_ontology_term_id": v for k, v in {"cell_type": "cell_type", "tissue": "tissue", "disease": "disease", "development_stage": "stage", "assay": "assay", "self_reported_ethnicity": "ethnicity", "sex": "sex", "organism": "organism", "age": "stage"}.items()}


def translate_value(spark: SparkSession, ontology: DataFrame, value: str | list | set | dict, label: str = "cell_type_ontology_term_id"):
    """Names for a few ids: a string or set gives {id: name}, a list the names in order, a mapping {name: count}.
    An unknown label type gives None. For columns of ids, use :func:`translate`."""
    if label not in TRANSLATED:
        return None
    asked: Iterable[str] = [value] if isinstance(value, str) else value
    rows = spark.createDataFrame([(x,) for x in dict.fromkeys(asked)], "ids string")
    names = {r.ids: r.name for r in translate(rows, ontology, TRANSLATED[label]).collect()}
    if isinstance(value, dict):
        return {names[k]: n for k, n in value.items()}
    if isinstance(value, list):
        return [names[k] for k in value]
    return names


def roll_up_ages(obs: DataFrame, ontology: DataFrame, groups: dict[str, str], stage: str = "stage", organism: str = "organism", unknown: str = "unknown") -> DataFrame:
    """Add ``age_group``: for human cells the stage's group or else its first parent's that has one; for mouse
    cells the stage's own or unknown; for others null."""
    table = obs.sparkSession.createDataFrame(list(groups.items()), "ontology_id string, grp string")
    own = table.select(F.col("ontology_id").alias("s0"), F.col("grp").alias("own"))
    up = parent_edges(ontology).join(F.broadcast(table), F.col("parent") == F.col("ontology_id")).groupBy(F.col("child").alias("s1")).agg(F.min_by("grp", "parent").alias("up"))
    at = obs.join(F.broadcast(own), F.col(stage) == F.col("s0"), "left").join(up, F.col(stage) == F.col("s1"), "left")
    human = F.coalesce("own", "up", F.lit(unknown))
    group = F.when(F.col(organism) == "NCBITaxon:9606", human).when(F.col(organism) == "NCBITaxon:10090", F.coalesce("own", F.lit(unknown)))
    return at.withColumn("age_group", group).drop("s0", "s1", "own", "up")
