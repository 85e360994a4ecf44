"""Mixing sources to target weights by Poisson replication.

A source with target share w of a budget of B bytes and S bytes of its own repeats at the rate w * B / S on average.
Each document's count is the inverse of the Poisson distribution of that mean at a uniform number hashed from a seed and
its doc_id, so a rerun draws the same. A row without doc_id is drawn by its content and its place among all such rows in the order of their
contents, so every one of them has a number of its own. Documents are exploded by their counts, and copies are spread by a second hash in
a range shuffle, which is a global shuffle. Rates come from one aggregate over the sources.

Defined cases: a null source is a source of its own; a null text has no bytes (a document counts 1 byte at least); rows
with equal doc_id draw alike, rows without doc_id each for itself; weights of absent sources are left out and the others scaled up; an empty table gives an
empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._shared import fresh, small
from quillgraph.operators.tables import ranked_globally

MADE = ("mix_rate", "mix_copy", "mix_order")

#: The rates of at most this many sources are broadcast; more are joined by a shuffle, where adaptive skew joins split hot ones.
SOURCES = 20_000


def uniform(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest of the seed and the columns."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(mix_source, rate, steps): mean repetition and distribution function of each source.

    ``weights``: target shares by source; without them shares are in proportion to bytes ** temperature. ``budget``: bytes
    of the mixture as a multiple of those of all documents.
    """
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("double")
    sources = docs.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.sum(size).alias("bytes"))
    if weights is not None:
        pairs = [F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("mix_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        weight = F.pow("bytes", F.lit(temperature))
    sources = sources.withColumn("weight", weight)
    whole = sources.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    rated = sources.crossJoin(F.broadcast(whole))  # one row
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") * budget / F.col("bytes")).otherwise(0.0)
    rated = rated.select("mix_source", rate.alias("rate"))
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    zero = F.struct(F.lit(0.0).cast("double").alias("ln"), F.lit(0.0).cast("double").alias("sum"), F.array().cast("array<double>").alias("steps"))

    def add(a: Column, k: Column) -> Column:
        ln = a["ln"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = a["sum"] + F.exp(k * F.log("rate") - F.col("rate") - ln)
        return F.struct(ln.alias("ln"), total.alias("sum"), F.concat(a["steps"], F.array(total)).alias("steps"))

    steps = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), most), zero, add)["steps"]).otherwise(F.array(F.lit(1.0)))
    return rated.withColumn("steps", steps)


def named(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with what each row is drawn by: its doc_id, or without one the digest of source and text and its place among these."""
    known = docs.where("doc_id is not null").withColumn(name, F.col("doc_id").cast("string"))
    lost = docs.where("doc_id is null")
    content, place, tie = fresh(docs, "content", "place", "tie")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lost = lost.withColumn(content, F.md5(F.concat(part("source"), F.lit("\n"), part("text"))))
    # rows of equal content may take any of their places, so ties go as the rows come, and a large group is cut anywhere
    lost = ranked_globally(lost.withColumn(tie, F.monotonically_increasing_id()), place, F.col(content), F.col(tie))
    return known.unionByName(lost.withColumn(name, F.concat(F.lit("~"), content, F.lit("~"), F.col(place).cast("string"))).drop(content, place, tie))


def mixed(docs: DataFrame, seed: str = "mix", weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """All columns of ``docs`` with mix_rate, mix_copy (from 1) and mix_order, one row per copy, in the order of mix_order.

    Columns of ``docs`` that have one of these three names are those of an earlier mixture and are replaced.
    """
    source, rate, steps, drawn, name = fresh(docs, "mix_source", "rate", "steps", "drawn", "name")
    table = small(rates(docs, weights, temperature, budget), SOURCES).toDF(source, rate, steps)
    rows = named(docs, name).join(table, F.coalesce("source", F.lit("")) == F.col(source))
    count = F.size(F.filter(steps, lambda s: s < F.col(drawn)))
    rows = rows.withColumn(drawn, uniform(seed, F.col(name))).withColumn(steps, count).where(F.col(steps) > 0)
    own = [F.col(c) for c in docs.columns if c not in MADE]
    copies = rows.select(*own, name, F.col(rate).alias("mix_rate"), F.explode(F.sequence(F.lit(1), F.col(steps))).alias("mix_copy"))
    copies = copies.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(name), F.col("mix_copy").cast("string")))).drop(name)
    return copies.repartitionByRange("mix_order").sortWithinPartitions("mix_order")
