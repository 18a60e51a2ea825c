"""The stages of the corpus pipeline: each takes documents and returns those it keeps, with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from .bits import cells, filter_bits, filter_words, may_hold
from .decontaminate import free_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, unchanged."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, name = model.score(docs, "text", docs.columns)
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; ``n_chars``, where there is one, follows the text."""
    out = line_dedup.dedup_lines(docs, short_repeats=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, and all rows that are in none.

    That with the smallest id stays (null last), of several texts under this id the one with the smallest hash, and of
    rows that share id and text one. Rows without words are in no group.
    """
    columns, name, copies = docs.columns, free_name(docs, "name"), free_name(docs, "copies")
    named = docs.withColumn(name, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = jaccard_join.jaccard_groups(named.select(name, "text"), key=name).filter("n_shingles > 0")
    groups = written(groups.select(F.col("doc_id").alias("member"), F.col("component_id").alias("group")), "groups")
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    members = groups.join(several, "group").groupBy("member").agg(F.min("group").alias("group"))
    members = written(members, "members")
    bits = filter_bits(members.count())
    wanted = filter_words(members.select(F.explode(F.array(*cells(bits, "member"))).alias("cell")).distinct(), bits)
    # Only rows that may be in a group of several are shuffled, first without their texts.
    maybe = may_hold(wanted, bits, name)
    at = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", F.col(name).alias("member"))
    ids = named.filter(maybe).select(at.alias("at"), F.col(name).alias("member")).distinct().join(members, "member")
    least = ids.groupBy("group").agg(F.min("at").alias("first"))
    ends = ids.join(least, "group").select("at.doc_id", "member", (F.col("at") == F.col("first")).alias("stays"))
    own, named_, stays = (free_name(docs, c) for c in ("own_id", "member", "stays"))
    ends = written(ends, "ends").toDF(own, named_, stays)
    same = F.col(name).eqNullSafe(F.col(named_)) & F.col("doc_id").eqNullSafe(F.col(own))
    found = named.filter(maybe).join(ends, same, "left")
    alone = found.filter(F.col(stays).isNull()).select(*columns)
    # Of rows that share id and text a task sends one.
    row = F.struct(*columns)
    first = found.filter(stays).groupBy("doc_id", name).agg(F.min_by(row, F.xxhash64(*columns)).alias(copies))
    return named.filter(~maybe).select(*columns).unionByName(alone).unionByName(first.select(f"{copies}.*").select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, unchanged."""
    found, name = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontaminate.is_contaminated(name)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)
