"""Mixing sources to target weights by Poisson replication.

Every document draws a repetition count from a Poisson distribution whose mean
is its source's target rate.  The draw inverts the distribution at a uniform
number hashed from the document's id, so it needs no state, is the same on
every run and after every lost executor, and copies of one rate are nested: a
document kept at rate r is kept at every higher rate up to MAX_RATE.  A higher
rate is the sum of independent draws by further hashes, each of MAX_RATE, and of
one for the remainder, so no source misses its target for being small.
Documents are exploded by their counts and dealt out by a random key, which
shuffles them globally.

Cases: a weighted source that the table doesn't have gives its share to the others
in proportion, as does the rest if every source is weighted; a null source is the source ``""``; null and empty texts weigh one byte
so that they can be drawn; repeated rows of one doc_id draw the same count; a
null doc_id is replaced by a digest of the text; an empty table gives an empty
one.  Other columns are carried through, whatever their names; the two columns
that are added get underscores in front if their names are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import fresh

#: Uniform numbers have this many hexadecimal digits (52 bits, exact in a double).
DIGITS = 13
#: Largest rate of one draw; higher rates take several.
MAX_RATE = 16.0
#: Copies that one row makes at once where some rate takes several draws.
BLOCK = 256


def terms(rate: float) -> int:
    """Smallest k whose upper tail lies below the resolution of the draw."""
    k, term, tail = 0, math.exp(-rate), 1.0
    while tail > 2.0**-53 and k < 200:
        tail -= term
        k += 1
        term *= rate / k
    return k


def identity() -> Column:
    """What a document's draws and order are hashed from."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def uniform(*prefix: Column) -> Column:
    """A number in [0, 1) from the prefix and the document's identity."""
    digest = F.md5(F.concat(*prefix, F.lit(":"), identity()))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float], budget: float) -> dict[str | None, float]:
    """Mean repetition rate of each weighted source and, under None, of all others.

    ``weights`` gives target shares of the listed sources; the other sources
    share what is left in proportion to their size.  ``budget`` is the size of
    the mix as a multiple of the corpus.  The aggregate has one row for each
    weighted source and one for the rest, so what reaches the driver is bounded
    by the configuration.
    """
    size = F.greatest(F.octet_length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    bucket = F.when(source.isin(list(weights)), source)
    got = {r["bucket"]: int(r["bytes"]) for r in docs.groupBy(bucket.alias("bucket")).agg(F.sum(size.cast("long")).alias("bytes")).collect()}
    total = sum(got.values())
    rest = max(0.0, 1.0 - sum(weights.values()))
    shares = {**weights, None: rest}
    present = sum(shares[s] for s in sorted(got, key=str))
    return {s: budget * shares[s] / present * total / got[s] if present else 0.0 for s in got}


def further(rate: float) -> int:
    """Draws of MAX_RATE besides the one for the remainder."""
    return max(0, math.ceil(rate / MAX_RATE) - 1)


def cdf(rate: float) -> Column:
    """The distribution function at 0, 1, ... as an array of constants."""
    total, term, out = 0.0, math.exp(-rate), []
    for k in range(terms(rate)):
        total += term
        term *= rate / (k + 1)
        out.append(F.lit(total))
    return F.array(*out)


def mix(docs: DataFrame, weights: dict[str, float], budget: float = 1.0, seed: int = 1) -> DataFrame:
    """Documents repeated to the target weights, globally shuffled.

    Adds ``mix_copy`` (from 0) and ``mix_key`` (the random order).  Rows are
    dealt by ``mix_key``, which is unique for each document and copy, so a hot
    source spreads evenly, and sorted by it inside each partition.
    """
    found = rates(docs, weights, budget)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))

    def by_source(of) -> Column:
        out = of(found.get(None, 0.0))
        for s in sorted(x for x in found if x is not None):
            out = F.when(source == F.lit(s), of(found[s])).otherwise(out)
        return out

    copy, order, u, table = (fresh(docs, n) for n in ("mix_copy", "mix_key", "mix_u", "mix_cdf"))
    steps = by_source(lambda rate: cdf(rate - MAX_RATE * further(rate)))
    rows = docs.select(*docs.columns, uniform(F.lit(str(seed))).alias(u), steps.alias(table))
    # the count is the k with cdf(k-1) <= u < cdf(k): a copy for each step at or below u
    below = F.filter(F.col(table), lambda c: F.col(u) >= c)
    if any(map(further, found.values())):
        rows = _many(rows, F.size(below), by_source(lambda rate: F.lit(further(rate))), copy, seed)
    else:
        rows = rows.withColumn(copy, F.explode(F.transform(below, lambda c, i: i)))
    key = F.md5(F.concat(F.lit(f"{seed}/"), identity(), F.lit("/"), F.col(copy).cast("string")))
    return rows.withColumn(order, key).drop(u, table).repartition(F.col(order)).sortWithinPartitions(order)


def _many(rows: DataFrame, first: Column, draws: Column, copy: str, seed: int) -> DataFrame:
    """Rows with a copy number each, where a document draws ``draws`` more times.

    Blocks of copies are dealt out before they are made, so the copies of a
    source of one document are made by many tasks.
    """
    total, block = fresh(rows, "mix_total"), fresh(rows, "mix_block")
    full = cdf(MAX_RATE)
    drawn = F.transform(F.when(draws > 0, F.sequence(F.lit(1), draws)).otherwise(F.array().cast("array<int>")), lambda j: uniform(F.lit(f"{seed}+"), j.cast("string")))
    more = F.aggregate(drawn, F.lit(0), lambda n, v: n + F.size(F.filter(full, lambda c: v >= c)))
    counted = rows.withColumn(total, first + more).where(F.col(total) > 0)
    blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0), F.col(total) - 1, F.lit(BLOCK))))
    last = F.least(F.col(block) + (BLOCK - 1), F.col(total) - 1)
    return blocks.repartition(identity(), F.col(block)).withColumn(copy, F.explode(F.sequence(F.col(block), last))).drop(total, block)
