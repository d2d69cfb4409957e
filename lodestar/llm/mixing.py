"""Temperature mixing of sources.

Source weights are ``share_s ** alpha`` normalised, with the shares taken over
tokens. The exponent is found by sectioning [0, 1]: the largest alpha whose
weights reach a target entropy, or the smallest whose most repeated source stays
within a repetition limit; a target that no exponent meets is an error. The token
budget is then realised per source in passes over the source. A pass is a block
permutation: a Feistel permutation of the source's blocks, another one each pass, and
within a block the rows by a hash of the pass; the last pass ends where the budget does.

Only per-source totals and per-(source, block) sums are ever shuffled; a row's
copies follow from its source's plan and its own hash, so a source that holds a
third of all rows needs no task of its own. Where the budget ends is found block by
block, then part by part of that block, then row by row of that part: the rows that
meet in one task are 1 / (blocks * PARTS) of a source.

Cases: null source is a source of its own; null or empty text has no tokens and
takes part in whole passes only; rows equal in id and text share a place in the
permutation and are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, text_or_empty
from lodestar.llm.sharding import permuted

SECTIONS = 16  # candidate exponents evaluated in one aggregation
PASSES = 8  # 16^-8: the exponent is exact to 3e-10
PARTS = 1024  # parts of the block where a budget ends
BROADCAST_SOURCES = 50_000  # plans of more sources are joined by shuffle


@dataclass(frozen=True)
class MixTarget:
    """What fixes the exponent: a repetition limit, or an entropy in nats."""

    max_repetition: float | None = 2.0
    entropy: float | None = None
    budget_tokens: int | None = None  # default: the least repeated source is taken once
    blocks: int = 1024
    seed: int = 20


def token_count(name: str = "text"):
    """Whitespace-separated words."""
    trimmed = F.trim(F.regexp_replace(text_or_empty(name), r"[\x09-\x0D]", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def find_exponent(totals: DataFrame, target: MixTarget) -> float:
    """Section [0, 1] for the exponent; each pass is one aggregation over sources."""
    if (target.max_repetition is None) == (target.entropy is None):
        raise ValueError("set exactly one of max_repetition and entropy")
    stats = totals.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    total = stats.agg(F.sum("t")).first()[0]
    if not total:
        return 1.0
    budget = target.budget_tokens

    def meets(alphas: list[float]) -> list[bool]:
        aggs = []
        for i, alpha in enumerate(alphas):
            share = F.pow(F.col("t") / F.lit(total), F.lit(alpha))
            aggs.append(F.sum(share).alias(f"z{i}"))
            aggs.append(F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0)).alias(f"h{i}"))
            aggs.append(F.max(share / F.col("t")).alias(f"hi{i}"))
            aggs.append(F.min(share / F.col("t")).alias(f"lo{i}"))
        row = stats.agg(*aggs).first()
        out = []
        for i in range(len(alphas)):
            z = row[f"z{i}"]
            if target.entropy is not None:
                # flatter weights (smaller exponents) have more entropy
                out.append(math.log(z) - row[f"h{i}"] / z >= target.entropy)
            else:
                used = budget if budget is not None else z / row[f"lo{i}"]
                out.append(row[f"hi{i}"] / z * used <= target.max_repetition * (1 + 1e-12))
        return out

    low, high = 0.0, 1.0
    wanted_low = target.entropy is not None  # entropy holds near 0, the limit holds near 1
    ends = meets([low, high])
    if not any(ends):
        raise ValueError(f"no exponent between 0 and 1 meets {target}")
    if ends[1] if wanted_low else ends[0]:
        return 1.0 if wanted_low else 0.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        ok = meets(grid)
        points = [low, *grid, high]
        if wanted_low:
            k = sum(ok)  # the exponents that still reach the entropy come first
            low, high = points[k], points[k + 1]
        else:
            k = len(ok) - sum(ok)
            low, high = points[k], points[k + 1]
    return low if wanted_low else high


def block_order(h: Column, epoch: Column, target: MixTarget) -> Column:
    """The row's place in the block permutation of a pass, a key that rises with it: the
    permuted block above, a hash of the pass and the row below."""
    blocks = max(1, target.blocks)
    low = 63 - (blocks - 1).bit_length()
    own = F.pmod(F.shiftright(h, 20), F.lit(blocks))
    turn = F.pmod(F.xxhash64(F.lit(target.seed), epoch), F.lit(blocks))
    place = permuted(F.pmod(permuted(own, blocks, target.seed) + turn, F.lit(blocks)), blocks, target.seed + 1)
    within = F.shiftrightunsigned(F.xxhash64(epoch, h), 64 - low)
    return F.call_function("shiftleft", place, F.lit(low)).bitwiseOR(within)


def _block_of(key: Column, target: MixTarget) -> Column:
    return F.shiftright(key, 63 - (max(1, target.blocks) - 1).bit_length())


def _ends(rows: DataFrame, need: DataFrame, shift: int) -> DataFrame:
    """(src, cut, rest): the group of keys (by their bits above ``shift``) where each source's
    need of tokens ends, and what is left of it there. ``need``: (src, rest)."""
    groups = rows.groupBy("__src", F.shiftright("__key", shift).alias("cut")).agg(F.sum("__tok").alias("tok"))
    before = Window.partitionBy("__src").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    return (
        groups.withColumn("before", F.coalesce(F.sum("tok").over(before), F.lit(0)))
        .join(need.select("src", "rest"), F.col("__src") == F.col("src"))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("tok")))
        .select("src", "cut", (F.col("rest") - F.col("before")).alias("rest"))
    )


def mixing_plan(rows: DataFrame, target: MixTarget, scratch: Scratch) -> DataFrame:
    """One row a source: tokens, weight, passes, and where the last pass ends.

    ``rows`` has ``__src``, ``__tok`` and ``__h`` (a 63-bit hash of the row). A row belongs
    to the last, partial pass when its key in that pass comes before ``cut_key``.
    """
    totals = rows.groupBy("__src").agg(F.sum("__tok").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    totals = scratch.cut(totals, "mix_totals")
    alpha = find_exponent(totals, target)
    t = F.col("tokens").cast("double")
    total = totals.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    raw = totals.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(t / F.lit(total), F.lit(alpha))).otherwise(0.0))
    z, least = raw.agg(F.sum("raw"), F.min(F.when(F.col("tokens") > 0, F.col("raw") / t))).first()
    z = z or 1.0
    budget = float(target.budget_tokens) if target.budget_tokens is not None else z / (least or 1.0)
    wanted = F.floor(F.col("weight") * F.lit(budget) * F.lit(1 + 1e-12)).cast("long")
    plan = (
        raw.withColumn("weight", F.col("raw") / F.lit(z))
        .withColumn("budget", wanted)
        .withColumn(
            "passes",
            F.when(F.col("tokens") > 0, F.call_function("div", F.col("budget"), F.col("tokens")))
            .otherwise(F.lit(1 if target.budget_tokens is None else 0))
            .cast("long"),
        )
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
        .withColumn("exponent", F.lit(alpha))
        .drop("raw")
    )
    plan = scratch.cut(plan, "mix_sources")
    small = plan.select(F.col("__src").alias("src"), "passes", "rest").filter("rest > 0")
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    keyed = rows.join(small, F.col("__src") == F.col("src")).select("__src", "__tok", block_order(F.col("__h"), F.col("passes"), target).alias("__key"))
    keyed = scratch.cut(keyed, "mix_keys")
    shift = 63 - (max(1, target.blocks) - 1).bit_length()
    ends = plan.select(F.col("__src").alias("src"), "rest").filter("rest > 0")
    here = keyed
    for level in (shift, max(0, shift - (PARTS - 1).bit_length())):
        ends = scratch.cut(_ends(here, ends, level), f"mix_ends_{level}")
        here = here.join(ends.select("src", "cut"), (F.col("__src") == F.col("src")) & (F.shiftright("__key", level) == F.col("cut"))).select(*keyed.columns)
    upto = Window.partitionBy("__src").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # in the last part row by row; whole parts before it
    cut = (
        here.withColumn("upto", F.sum("__tok").over(upto)).join(ends, F.col("__src") == F.col("src"))
        .groupBy(F.col("__src").alias("c_src"))
        .agg(
            F.coalesce(
                F.max(F.when(F.col("upto") <= F.col("rest"), F.col("__key"))),
                F.call_function("shiftleft", F.min("cut"), F.lit(level)) - 1,
            ).alias("cut_key")
        )
    )
    return plan.join(cut, F.col("__src") == F.col("c_src"), "left").drop("c_src")


def mix_sources(
    df: DataFrame, scratch: Scratch, target: MixTarget = MixTarget(),
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Every column of df once per copy, with ``mix_epoch`` (0-based copy), ``mix_tokens``,
    ``mix_weight``, ``mix_exponent``, ``mix_block`` (the place of the row's block in that
    epoch's permutation) and ``mix_key`` (the row's place in it: blocks first, rows within).
    Columns of these names give way."""
    made = ("mix_epoch", "mix_tokens", "mix_weight", "mix_exponent", "mix_block", "mix_key")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    prepared = df.select(
        F.struct(*kept).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")).alias("__src"),
        token_count(text_col).alias("__tok"),
        F.xxhash64(F.lit(target.seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).bitwiseAND(F.lit((1 << 63) - 1)).alias("__h"),
    )
    narrow = scratch.cut(prepared.select("__src", "__tok", "__h"), "mix_rows")
    plan = scratch.cut(mixing_plan(narrow, target, scratch), "mix_plan")
    scratch.close("mix_plan")
    small = plan.select("__src", F.col("weight").alias("mix_weight"), F.col("exponent").alias("mix_exponent"), "passes", "cut_key")
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    placed = prepared.join(small, "__src")
    partial = F.coalesce(block_order(F.col("__h"), F.col("passes"), target) <= F.col("cut_key"), F.lit(False))
    copies = F.when(F.col("cut_key").isNotNull() & (F.col("__tok") > 0) & partial, F.col("passes") + 1).otherwise(F.col("passes"))
    return (
        placed.withColumn("__copies", copies)
        .filter(F.col("__copies") > 0)
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__copies").cast("int") - 1)))
        .withColumn("mix_tokens", F.col("__tok"))
        .withColumn("mix_key", block_order(F.col("__h"), F.col("mix_epoch").cast("long"), target))
        .withColumn("mix_block", _block_of(F.col("mix_key"), target).cast("int"))
        .select("row.*", *made)
    )
