"""Document fingerprints by spot signatures.

Every occurrence of a common word (an anchor) starts a chain of the next
CHAIN content words, skipping further anchors; anchor and chain hash to one
signature. A text's fingerprint is its set of signatures, a text without any
complete chain has its whole text as the only one, and an empty text has none.
Fingerprints are compared by Jaccard likeness. ``similar_fingerprints`` finds all
pairs above a threshold: sets are partitioned by length, joined on their rarest
members only (prefix bound), pruned by length and verified.

Built from DataFrame functions only. Cases: null counts as the empty text; two
empty fingerprints are alike (1.0), an empty and a full one are not (0.0); rows
equal in id and text count once in the order of documents; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch
from lodestar.llm.sharding import numbered

CHAIN = 2
SENT_BYTES = 5  # of a signature, to compare a document with the next one: two of one pair are taken as equal with a chance of 1e-7
# Common words of the languages handled.
ANCHORS = tuple(
    """the a an of to and in is was are be for that it with on by this
    der die das und ist ein eine von zu mit den dem auf
    le la les un une de du des et est que en dans pour
    el los las y del se con por""".split()
)


def word_hashes(text: Column) -> Column:
    """array<bigint>: the words of a text (not null), in order, lower-cased and without punctuation."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))
    return F.when(plain != "", F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def signed(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``, the distinct signatures (array<bigint>) of the column ``text``.

    The j-th anchor, at word p, has p - j content words before it, so its chain is
    the content words from number p - j on, however many anchors lie between.
    """
    words = lambda x: x.isin(*_anchor_hashes(df.sparkSession))
    # a projection of its own for each list: compiled, and made once
    step = df.select("*", word_hashes(F.col(text)).alias("__w"))
    step = step.select(
        "*", F.filter("__w", lambda x: ~words(x)).alias("__content"),
        F.filter(F.transform("__w", lambda x, i: F.when(words(x), i)), lambda i: i.isNotNull()).alias("__anchors"),
    )
    chain = lambda p, j: F.xxhash64(F.get("__w", p), *[F.get("__content", p - j + k) for k in range(CHAIN)])
    made = F.transform("__anchors", lambda p, j: F.when(p - j + CHAIN <= F.size("__content"), chain(p, j)))
    step = step.select("*", F.array_distinct(F.filter(made, lambda x: x.isNotNull())).alias("__sigs"))
    none = F.array().cast("array<bigint>")
    sigs = F.when(F.size("__sigs") > 0, F.col("__sigs")).when(F.col(text) != "", F.array(F.xxhash64(F.col(text)))).otherwise(none)
    return step.select("*", sigs.alias(out)).drop("__w", "__content", "__anchors", "__sigs")


def _anchor_hashes(spark) -> list[int]:
    """The hashes of the anchors; a fixed, short list."""
    if not _ANCHORS:
        rows = spark.createDataFrame([(w,) for w in ANCHORS], "w string").select(F.xxhash64("w")).collect()
        _ANCHORS.extend(r[0] for r in rows)
    return _ANCHORS


_ANCHORS: list[int] = []


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def packed(s: Column) -> Column:
    """The upper SENT_BYTES bytes of each signature, one after the other: half of what a shuffle would carry."""
    wide = 2 * SENT_BYTES
    return F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 64 - 4 * wide)), wide, "0")), ""))


def common_with_packed(s: Column, body: Column) -> Column:
    """How many signatures of s are in a packed set."""
    n = F.call_function("div", F.octet_length(body), F.lit(SENT_BYTES)).cast("int")
    # the substring of a hexadecimal text, as one of bytes would have to be encoded again
    text = lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 64 - 8 * SENT_BYTES)), 2 * SENT_BYTES, "0")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.hex(F.substring(body, i * SENT_BYTES + 1, F.lit(SENT_BYTES))))
    return F.when(n > 0, F.size(F.array_intersect(F.transform(s, text), parts))).otherwise(0)


def fingerprint_text(s: Column) -> Column:
    """The sorted signatures as hexadecimal words."""
    return F.array_join(
        F.transform(F.array_sort(s), lambda x: F.lower(F.hex(x))), " "
    )


def edit_checks(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n/3) code points replaced by the first as
    many of the next document (descending id, cyclic). The order is found on ids
    alone; texts are shuffled once, by document, and each document sends its
    predecessor no more than the piece that it needs.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keyed = docs.select("id", F.xxhash64("t").alias("h"), "t")
    narrow = keyed.select("id", "h", F.length("t").cast("long").alias("n")).distinct()
    # ids fall along the order: the complement of an id rises
    ordered, count = numbered(narrow, [F.bitwise_not(F.col("id")), F.col("h")], scratch, "spot_order")
    after = ordered.select(
        F.pmod(F.col("row_no") - 1, F.lit(max(1, count))).alias("row_no"), F.col("id").alias("next_id"), F.col("h").alias("next_h")
    )
    # one row a document: which document follows it, and how much of that it takes
    wants = scratch.cut(
        ordered.join(after, "row_no").select(
            F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("take"), "next_id", "next_h"
        ), "spot_wants",
    )
    scratch.drop("spot_order")
    sent = signed(
        keyed.join(wants, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("h") == F.col("next_h")))
        .select("to_id", "to_h", "take", "t"), "t", "next_sigs",
    ).select("to_id", "to_h", F.left("t", "take").alias("piece"), packed(F.col("next_sigs")).alias("next_sigs"))
    # rows equal in id and text each sent the same piece
    sent = sent.dropDuplicates(["to_id", "to_h"])
    joined = keyed.join(sent, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h")))
    n = F.length("t").cast("long")
    made = joined.select(
        F.col("id").alias(id_col), n.alias("n_chars"), "next_sigs", "t",
        F.concat(F.left("t", (n - F.floor(n / 3)).cast("int")), "piece").alias("edited"),
    )
    made = signed(signed(made, "t", "sigs").drop("t"), "edited", "edited_sigs")
    n_next = F.octet_length("next_sigs") / SENT_BYTES
    common = common_with_packed(F.col("sigs"), F.col("next_sigs"))
    return made.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("sigs")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        F.when((F.size("sigs") == 0) & (n_next == 0), F.lit(1.0))
        .otherwise(common / (F.size("sigs") + n_next - common)).alias("near_next"), F.size("sigs").alias("n_signatures"),
    )


def similar_fingerprints(sets: DataFrame, threshold: float = 0.75, key: str = "key", sigs: str = "sigs") -> DataFrame:
    """(a, b, likeness) for every pair of distinct non-empty sets with likeness >= threshold.

    ``sets`` has one row a class of equal fingerprints. A pair at the threshold
    shares one of the rarest n - ceil(threshold*n) + 1 members of either side.
    """
    base = sets.select(F.col(key).alias("k"), F.array_distinct(sigs).alias("s")).filter(F.size("s") > 0)
    members = base.select("k", F.size("s").alias("n"), F.explode("s").alias("m"))
    df_of = members.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    ranked = members.join(df_of, "m").groupBy("k").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "m"))).alias("r")
    )
    prefix = ranked.select(
        "k", "n", F.explode(F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int"))).alias("e")
    ).select("k", "n", F.col("e.m").alias("m"))
    # length partitions: each a factor 1/threshold wide, so partners are in the same or the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    left = prefix.select("m", band.alias("band"), F.col("k").alias("a"), F.col("n").alias("na"))
    right = prefix.select("m", F.explode(F.array(band, band - 1)).alias("band"), F.col("k").alias("b"), F.col("n").alias("nb"))
    pairs = (
        left.join(right, ["m", "band"])
        .filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        .filter(F.col("na") >= F.col("nb") * F.lit(threshold)).select("a", "b").distinct()
    )
    x = base.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    y = base.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(x, "a").join(y, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("likeness") >= F.lit(threshold)).select("a", "b", "likeness")
