"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the corpus. Each row
is repeated a Poisson number of times with that mean: the inverse of the Poisson distribution at a uniform
number that a hash of seed and id gives, so that the result depends on neither partitioning nor run. The
copies are dealt globally by another hash. All steps are column expressions.

Rates are a table with a row for each source, joined to the documents. It is written first, so that Spark
knows its size and broadcasts it only where small; a source with a third of all rows is then no burden, and
larger tables are joined by sort and merge, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LARGEST = 200.0  # mean of one draw; a larger one is the sum of several draws, so that no table grows with it
DIGITS = 13  # hexadecimal digits of the hash that make the uniform number: 52 bits


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts: a multiple of 2^-52, and a half more."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    whole = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long").cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(1 << 4 * DIGITS))


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as it is distinguishable from 1.

    Terms are taken from their logarithms, so that rates of many hundreds do not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state, k):
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(
            log.alias("log"), total.alias("sum"), F.concat(state["cdf"], F.array(total)).alias("cdf")
        )

    table = F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["cdf"])
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict | None, temperature: float, growth: float) -> DataFrame:
    """(source, bytes, rate) for every source, a null source included.

    weights: target weights by source; sources without one get none. Without weights the target is
    bytes ** temperature. growth: bytes of the output over bytes of the input. Sources without
    bytes have rate `growth`.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("bytes")
    )
    if weights is None:
        target = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w)))]
        target = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = materialize(sizes.withColumn("target", target), "sources")
    whole = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("target").alias("all_target")).first()
    total, targets = float(whole["all_bytes"] or 0), float(whole["all_target"] or 0)
    if not targets:
        rate = F.lit(0.0 if weights else float(growth))
    else:
        share = F.col("target") / F.lit(targets)
        rate = F.when(F.col("bytes") > 0, F.lit(growth) * share * F.lit(total) / F.col("bytes")).otherwise(F.lit(float(growth)))
    return sizes.select("source", "bytes", rate.alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, growth: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Every row of docs as often as its draw says, with its copy number from 1 in `copy`, dealt globally.

    Rows that share an id, or have none, share its draw. A null source is a source of its own; a null text has no
    bytes, and texts of any length are only moved. `copy` replaces a column of that name. An empty table gives no rows.
    """
    rates = source_rates(docs, source_col, text_col, weights, temperature, growth)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST)).cast("int"))
    tables = rates.withColumn("_loom_parts", parts).select(
        F.col("source").alias("_loom_source"), "_loom_parts", poisson_table(F.col("rate") / F.col("_loom_parts")).alias("_loom_cdf")
    )
    tables = materialize(tables, "rates")
    drawn = docs.drop("copy").join(tables, docs[source_col].eqNullSafe(tables["_loom_source"]))
    word, name = F.lit(f"poisson{seed}"), F.col(id_col).cast("string")

    def inverse(u):
        return F.size(F.filter("_loom_cdf", lambda c: c < u))

    more = F.aggregate(
        F.sequence(F.lit(1), F.col("_loom_parts") - 1), F.lit(0), lambda a, j: a + inverse(uniform(word, name, j.cast("string")))
    )
    copies = inverse(uniform(word, name)) + F.when(F.col("_loom_parts") > 1, more).otherwise(0)
    drawn = drawn.withColumn("_loom_n", copies).drop("_loom_cdf", "_loom_source", "_loom_parts").where("_loom_n > 0")
    copied = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_loom_n")))).drop("_loom_n")
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"))
    dealt = copied.withColumn("_loom_place", place).repartition("_loom_place").sortWithinPartitions("_loom_place")
    return dealt.drop("_loom_place")


SQL = r"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source),
shares AS (
  SELECT source, bytes, pow(CAST(bytes AS DOUBLE), 0.5) AS target,
         sum(pow(CAST(bytes AS DOUBLE), 0.5)) OVER () AS targets, CAST(sum(bytes) OVER () AS DOUBLE) AS total
  FROM sizes),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN target / targets * total / bytes ELSE 1.0 END AS rate FROM shares),
terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM rates, range(0, 400) t(k)),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM terms),
drawn AS (
  SELECT d.*, (CAST(('0x' || substr(md5('poisson17|' || d.doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d),
counts AS (
  SELECT d.doc_id, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p < d.u) AS n
  FROM drawn d)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy
FROM documents d JOIN counts USING (doc_id)
"""
