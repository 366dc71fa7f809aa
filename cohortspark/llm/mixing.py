"""Mixing sources to target weights, in built-in expressions only.

Weights are token shares raised to an exponent between 0 (all sources alike) and 1 (as they are), and normalised. The
exponent is bisected: the smallest one at which no source is repeated more than ``max_repeats`` times, or the largest one
whose weights have at least the entropy ``target_entropy`` (a share of the greatest possible entropy); of both, the
larger exponent counts. Without a budget the mixture is as large as it must be for every document to occur at least once.

A source's quota is its weight of the budget. Its documents are dealt out in epochs, each a permutation of its own by
digest order; all epochs but the last are whole, and of the last the documents whose running total stays within the
quota are taken. Blocks of ``block_tokens`` tokens hold every source by its weight, and a block is permuted again.

Running totals are taken in two steps, since one source may hold a third of all rows: a digest order is cut into even
pieces of about ``piece_rows`` documents, totals of pieces are summed up per source, and documents inside a piece.

One row gathers the token totals of all sources, so that the bisection is one expression; its size is the number of
sources. Defined results: a null source is a source; sources without tokens keep each document once, in block 0; repeated
rows of one document are one unit of ``copies`` rows; documents without an id are mixed like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import text_or_empty, written

MAX_REPEATS = 1.25
BLOCK_TOKENS = 1_000_000
PIECE_ROWS = 500
STEPS = 50
#: Digest orders are 60-bit numbers.
_RANGE = float(1 << 60)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, source, text) by digest: tokens of all its rows and how many rows it has."""
    text = text_or_empty("text")
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("text_key"),
                    token_count(text).alias("n"))
        .groupBy("doc_id", "source", "text_key")
        .agg(F.sum("n").alias("tokens"), F.count("*").alias("copies"))
    )


def exponent(shares: Column, max_repeats: float | None, target_entropy: float | None, budget_share: float | None) -> Column:
    """The bisected exponent for an array of token shares."""
    def powers(a: Column) -> Column:
        return F.transform(shares, lambda p: F.pow(p, a))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def few_repeats(a: Column) -> Column:
        per_token = F.transform(shares, lambda p: F.pow(p, a - 1))
        base = F.array_min(per_token) if budget_share is None else total(powers(a)) / F.lit(budget_share)
        return F.array_max(per_token) <= F.lit(max_repeats) * base

    def even(a: Column) -> Column:
        sums = total(powers(a))
        entropy = F.aggregate(powers(a), F.lit(0.0), lambda s, v: s - v / sums * F.ln(v / sums))
        return entropy >= F.lit(target_entropy) * F.ln(F.size(shares).cast("double"))

    def bisect(holds, low_holds: bool) -> Column:
        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def step(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            down = ~holds(middle) if low_holds else holds(middle)
            return F.struct(F.when(down, s["low"]).otherwise(middle).alias("low"),
                            F.when(down, middle).otherwise(s["high"]).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["high"])

    found = []
    if max_repeats is not None:
        found.append(bisect(few_repeats, low_holds=False))
    if target_entropy is not None:
        found.append(bisect(even, low_holds=True))
    if not found:
        return F.lit(1.0)
    return F.round(F.greatest(*found) if len(found) > 1 else found[0], 9)


def weights(units_: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
            budget: int | None = None) -> DataFrame:
    """Per source: total tokens, units, exponent, weight and quota of tokens."""
    totals = units_.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("units"))
    some = totals.where("total > 0")
    row = some.agg(F.sort_array(F.collect_list(F.col("total").cast("double"))).alias("totals")).select(
        F.aggregate("totals", F.lit(0.0), lambda s, v: s + v).alias("all"), "totals")
    shares = row.select("all", F.transform("totals", lambda t: t / F.col("all")).alias("shares"))
    budget_share = F.lit(float(budget)) / F.col("all") if budget else None
    tempered = shares.select(
        "all", exponent(F.col("shares"), max_repeats, target_entropy, budget_share).alias("exponent"), "shares")
    one = tempered.select(
        "all", "exponent",
        F.aggregate("shares", F.lit(0.0), lambda s, p: s + F.pow(p, F.col("exponent"))).alias("sum"),
        F.array_min(F.transform("shares", lambda p: F.pow(p, F.col("exponent") - 1))).alias("least"))
    size = F.lit(float(budget)) if budget else F.col("all") * F.col("sum") / F.col("least")
    share = F.col("total") / F.col("all")
    power = F.pow(share, F.col("exponent")) / F.col("sum")
    weight = F.round(power, 12)  # as reported; quotas come from the unrounded one
    quota = power * size if budget else F.col("total") * (F.pow(share, F.col("exponent") - 1) / F.col("least"))
    # a quota within a billionth of whole epochs is whole epochs
    epochs = F.round(quota / F.col("total"))
    whole = F.abs(quota / F.col("total") - epochs) < 1e-9
    quota = F.when(whole, epochs * F.col("total")).otherwise(F.floor(quota)).cast("long")
    if not budget:
        quota = F.greatest(quota, F.col("total"))  # every document occurs
    known = totals.join(one, F.lit(True), "left")  # one row meets all sources
    return known.select(
        "source", "total", "units", "exponent",
        F.when(F.col("total") > 0, weight).otherwise(0.0).alias("weight"),
        F.when(F.col("total") > 0, quota).otherwise(F.lit(0)).cast("long").alias("quota"),
        F.coalesce(size, F.lit(0.0)).alias("size"),
    )


def digest_order(seed: int, epoch: Column, doc_id: Column, text_key: Column | None = None) -> Column:
    """A 60-bit number that orders documents anew in every epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substr(F.md5(F.encode(name, "utf-8")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def mix(units_: DataFrame, weights_: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS,
        piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per unit and epoch taken: doc_id, source, text_key, tokens, copies, epoch, block, place.

    ``place`` counts from 0 inside a block, in the order of the block's permutation.
    """
    spread = weights_.withColumn("pieces", F.ceil(F.col("units") / piece_rows)).withColumn(
        "whole", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(F.lit(1)))
    spread = spread.withColumn("rest", F.col("quota") - F.col("whole") * F.col("total"))
    spread = spread.withColumn("epochs", F.col("whole") + (F.col("rest") > 0).cast("int"))
    rows = units_.alias("u").join(spread.withColumnRenamed("source", "_source"), F.col("u.source").eqNullSafe(F.col("_source")))
    rows = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("epochs") - 1).cast("int"))))
    rows = rows.withColumn("order", digest_order(seed, F.col("epoch"), F.col("doc_id")))
    rows = rows.withColumn("piece", F.floor(F.col("order") / _RANGE * F.col("pieces")))
    rows = written(rows.select("doc_id", "source", "text_key", "tokens", "copies", "epoch", "order", "piece", "total", "quota",
                               "whole", "rest", "size"), "mixing-epochs")
    sums = rows.groupBy("source", "epoch", "piece").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("source", "epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("piece").alias("_piece"),
                       F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "epoch", "piece").orderBy("order", "doc_id", "text_key").rowsBetween(
        Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("tokens").over(inside)).join(
        sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch"))
        & (F.col("piece") == F.col("_piece")))
    end = F.col("earlier") + F.col("_inside")
    taken = summed.where((F.col("epoch") < F.col("whole")) | (end <= F.col("rest")))
    position = F.col("epoch") * F.col("total") + end - F.col("tokens")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block_tokens))
    block = F.when(F.col("quota") > 0, F.least(blocks - 1, F.floor(position * blocks / F.col("quota")))).otherwise(0)
    taken = taken.withColumn("block", block.cast("long"))
    order = Window.partitionBy("block").orderBy("order", "doc_id", "text_key", "epoch")
    return taken.select("doc_id", "source", "text_key", "tokens", "copies", "epoch", "block",
                        (F.row_number().over(order) - 1).cast("long").alias("place"))


def mixture(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
            budget: int | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``mix`` for a table of documents, with the weight of their source."""
    stored = written(units(docs), "mixing-units")
    found = written(weights(stored, max_repeats, target_entropy, budget), "mixing-weights")
    return mix(stored, found, seed, block_tokens)


def realise(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of a mixture, each as often as it was taken, with the columns of ``docs``."""
    times = rows.groupBy("doc_id", "source", "text_key").agg(F.count("*").cast("int").alias("_times")).select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("text_key").alias("_key"), "_times")
    keyed = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"),
                        F.xxhash64(text_or_empty("text")).alias("_k"), F.struct("*").alias("_row"))
    met = keyed.join(times, F.col("_d").eqNullSafe(F.col("_doc")) & F.col("_s").eqNullSafe(F.col("_source"))
                     & (F.col("_k") == F.col("_key")))
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
