"""Mixing sources to target weights: a tempered share of each source, dealt as block permutations.

Everything here is DataFrame operations.  Source token shares ``p`` are raised to an exponent
``alpha`` in [0, 1] and normalised: 1 keeps the natural mix, 0 gives every source the same weight.
The exponent is the end of a bisection: with a target entropy, the largest that reaches it; with a
limit on repetition, the smallest that repeats no source more often.  Each pass over the
per-source table halves the bracket several times at once by testing a grid of exponents.

A source is then read in whole passes ("epochs"), each a permutation of its own, and a last partial
pass.  Documents fall into blocks by a hash of seed, epoch and row, two levels of 1024; blocks are
taken in order until the token budget is met, and only the block in which it ends is cut, at a
document.  Ranges of blocks are sized from counts, so no window ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, require, words_text

SEED = 29
#: A source is read at most so many times where the natural mix reads it once.
MAX_REPEAT = 1.25
#: Halvings of the exponent's bracket in a pass, and passes.
HALVINGS, PASSES = 4, 6
_FAN = 1024


def count_tokens(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.regexp_count(words_text(text), F.lit(r"[^ \t-\r]+")).cast("long")


def source_tokens(docs: DataFrame, tokens: Column, source: str = "source") -> DataFrame:
    """(source, docs, tokens) for each source; a null source is one of its own."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))


def bisect_exponent(sources: DataFrame, budget: int, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None) -> float:
    """The exponent that meets the target; ``sources`` has a column ``tokens``.

    With ``max_repeat``, the smallest exponent whose weights read no source more than that many
    times within ``budget`` tokens.  With ``min_entropy`` (in nats), the largest whose weights
    reach it.  Repetition is bounded by the natural mix's ``budget / total``, so a limit below that
    gives 1; an entropy above that of equal weights gives 0.
    """
    if (max_repeat is None) == (min_entropy is None):
        raise ValueError("give max_repeat or min_entropy, not both")
    live = sources.where("tokens > 0")
    total, least = live.agg(F.sum("tokens"), F.min("tokens")).first()
    if not total:
        return 1.0
    low, high = 0.0, 1.0
    steps = 1 << HALVINGS

    def passes(alphas: list[float]) -> list[bool]:
        share = F.col("tokens") / F.lit(float(total))
        wanted = []
        for k, a in enumerate(alphas):
            power = F.pow(share, F.lit(a))
            wanted += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(power)).alias(f"h{k}")]
        row = live.agg(*wanted).first()
        kept = []
        for k, a in enumerate(alphas):
            z = row[f"z{k}"]
            if max_repeat is not None:
                # weight / tokens is largest where tokens are least, as alpha <= 1
                kept.append((least / total) ** a / z * budget / least <= max_repeat)
            else:
                kept.append(math.log(z) - row[f"h{k}"] / z >= min_entropy)
        return kept

    ends = passes([0.0, 1.0])
    if max_repeat is not None:
        if ends[0] or not ends[1]:
            return 0.0 if ends[0] else 1.0
    elif ends[1] or not ends[0]:
        return 1.0 if ends[1] else 0.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / steps for k in range(1, steps)]
        kept = passes(grid)
        if max_repeat is not None:
            at = kept.index(True) if True in kept else steps - 1
        else:
            at = kept.index(False) if False in kept else steps - 1
        low, high = (low if at == 0 else grid[at - 1]), (high if at == steps - 1 else grid[at])
    return high if max_repeat is not None else low


def weights(sources: DataFrame, alpha: float, budget: int) -> DataFrame:
    """``sources`` with weight, target tokens, whole epochs and the tokens of the last, partial one."""
    live = F.col("tokens") > 0
    total = sources.where(live).agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    z = sources.where(live).agg(F.sum(power)).first()[0] or 1.0
    weight = F.when(live, power / F.lit(z)).otherwise(F.lit(0.0))
    target = F.floor(weight * F.lit(float(budget)) + 0.5).cast("long")
    out = sources.withColumn("weight", weight).withColumn("target_tokens", target)
    epochs = F.when(live, F.floor(F.col("target_tokens") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest_tokens", F.when(live, F.col("target_tokens") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))


def place(*parts: Column) -> Column:
    """A place in [0, 2^60) drawn from the parts: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def _last_pass(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the last pass: those whose tokens, with all before them in it, fit the rest.

    Level by level: sums of tokens by block give each source's block where its rest ends; blocks
    before it are taken whole, and only that block is looked at closer.
    """
    partial = plan.where("rest_tokens > 0").select(F.col("source").alias("s"), F.col("epochs").alias("e"), "rest_tokens")
    rows = slim.join(partial, slim.source.eqNullSafe(partial.s)).withColumn("spot", place(F.lit(SEED), F.col("e"), F.col("key")))
    rows = rows.withColumn("b1", F.shiftright("spot", 50)).withColumn("b2", F.shiftright("spot", 40).bitwiseAND(_FAN - 1))
    rows = rows.withColumn("left", F.col("rest_tokens"))
    taken = None
    for level in ("b1", "b2"):
        here = Window.partitionBy("s").orderBy(level)
        sums = rows.groupBy("s", level, "left").agg(F.sum("n_tokens").alias("t")).withColumn("upto", F.sum("t").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        state = sums.select(F.col("s").alias("s_"), F.col(level).alias("b_"), (F.col("upto") <= F.col("left")).alias("whole"), ((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("t") <= F.col("left"))).alias("ends"), (F.col("left") - F.col("upto") + F.col("t")).alias("after"))
        joined = rows.join(state.where("whole or ends"), rows.s.eqNullSafe(F.col("s_")) & (rows[level] == F.col("b_"))).withColumn("left", F.col("after"))
        whole = joined.where("whole").select(*slim.columns, F.col("e").alias("epoch"))
        taken = whole if taken is None else taken.unionAll(whole)
        rows = joined.where("ends").drop("s_", "b_", "whole", "ends", "after")
    upto = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("spot", "key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumn("upto", upto).where("upto <= left").select(*slim.columns, F.col("e").alias("epoch"))
    return taken.unionAll(cut)


def mix(docs: DataFrame, budget: int | None = None, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None, text: str = "text", source: str = "source", tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, plan): which documents are read in which epoch, and each source's weight.

    selection has doc_id, source, n_tokens, epoch (from 0), spot, the place within its epoch, and tie;
    a document is there once for each epoch that reads it.  ``budget`` is in tokens; by default as
    many as the input has.  Tokens of a source add up to its target, less than one document short.
    Null sources form one source, null texts have no tokens; documents without tokens are read once.
    Rows that repeat in doc_id share a place and are taken there in order of ``tie``, a hash of the
    text unless a column is named, so a rerun cuts at the same one; rows alike in it too stand for
    one another.  An empty table gives an empty selection; extra columns are ignored.
    """
    require(docs, "doc_id", text, source)
    slim = docs.select("doc_id", F.col(source).alias("source"), count_tokens(F.col(text)).alias("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.md5(words_text(F.col(text)))).alias("key"), (F.col(tie) if tie else F.xxhash64(words_text(F.col(text)))).alias("tie"))
    slim = materialize(slim, "tokens")
    sources = materialize(source_tokens(slim, F.col("n_tokens")), "sources")
    if budget is None:
        budget = sources.agg(F.sum("tokens")).first()[0] or 0
    alpha = bisect_exponent(sources, budget, max_repeat, min_entropy)
    plan = materialize(weights(sources, alpha, budget), "weights")
    whole = plan.where("epochs > 0").select(F.col("source").alias("s"), F.col("epochs").alias("e"))
    full = slim.join(whole, slim.source.eqNullSafe(whole.s)).select(*slim.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("e") - 1)).alias("epoch"))
    chosen = full.unionAll(_last_pass(slim, plan))
    return chosen.select("doc_id", "source", "n_tokens", "epoch", place(F.lit(SEED), F.col("epoch"), F.col("key")).alias("spot"), "tie"), plan


def apply_mix(docs: DataFrame, budget: int | None = None, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, each as often as it is read, in order.

    Rows come epoch by epoch, each in the order of its block permutation, by range partitions.  Null
    sources and texts, repeated rows and an empty table are taken as in mix(); rows that differ in
    any column are read as documents of their own, and the tokens read never go beyond the budget.
    """
    hash_, epoch, spot, n, copies = (free_name(docs, stem) for stem in ("mix_row", "mix_epoch", "mix_spot", "mix_times", "mix_copies"))
    keyed = docs.withColumn(hash_, F.xxhash64(*docs.columns))
    chosen, _ = mix(keyed, budget, max_repeat, min_entropy, tie=hash_)
    reads = chosen.groupBy(F.col("tie").alias(hash_), F.col("epoch").alias(epoch), F.col("spot").alias(spot)).agg(F.count("*").cast("int").alias(n))
    times = keyed.groupBy(hash_).agg(F.count("*").alias(copies)).where(F.col(copies) > 1)
    plan = materialize(reads.join(times, hash_, "left"), "reads")
    single = keyed.join(plan.where(F.col(copies).isNull()).drop(copies, n), hash_)
    # rows alike in all columns: one stands for all, as often as they are read together
    alike = keyed.join(plan.where(F.col(copies).isNotNull()).drop(copies), hash_).dropDuplicates([hash_, epoch, spot])
    alike = alike.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    out = single.select(*docs.columns, epoch, spot).unionAll(alike.select(*docs.columns, epoch, spot))
    return out.repartitionByRange(epoch, spot).sortWithinPartitions(epoch, spot).select(*docs.columns)
