"""Text expressions: folding, tokens, sentences, paragraphs, chunk arrays.

Everything here is a Column over Column function that stays inside the JVM,
except ``fold_exact``, which needs Unicode tables that Spark does not have.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented Latin-1 lower-case letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "aaaaaaceeeeiiiinooooouuuuyy"

# Portuguese function words left out of the lexical index. They are
# compared after folding, so accented entries only match what folding leaves alone.
STOP_WORDS = (
    "a à às ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e é "
    "ela elas ele eles em entre era eram essa essas esse esses esta está estas este estes eu foi foram há isso isto já lhe "
    "lhes mais mas me mesmo meu meus minha minhas muito na não nas nem no nos nós nossa nossas nosso nossos num numa o os "
    "ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus só sua suas também te tem têm teu teus tu "
    "tua tuas um uma umas uns você vocês"
).split()

HASH_TOKEN = r"[a-zà-ÿ0-9]+"
LEXICAL_TOKEN = r"[a-z0-9]+"
WHITE_SPACE = "\t\n\x0b\x0c\r "  # what \s is
MARK = b"\x00\x00\xfe\xff"  # of UTF-32, big-endian
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÀ-Ú0-9])"


def once(value: Column, use) -> Column:
    """``use(value)`` with value computed one time, however often use names it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def fold(c: Column) -> Column:
    """Lower case without Latin-1 accents, in the JVM."""
    return F.translate(F.lower(c), ACCENTED, BASE)


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Lower case without any combining mark (NFKD), for text beyond Latin-1."""

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))

    return texts.map(one)


def hash_tokens(c: Column) -> Column:
    """Tokens of the hashing embedder: accents and function words stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(HASH_TOKEN), F.lit(0))


def lexical_tokens(c: Column, remove_stop_words: bool = True, exact: bool = False) -> Column:
    """Tokens of the lexical index: folded, without stop words and single characters."""
    found = F.regexp_extract_all(fold_exact(c) if exact else fold(c), F.lit(LEXICAL_TOKEN), F.lit(0))
    if not remove_stop_words:
        return found
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def ngrams(tokens: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """All n-grams of the given sizes, shorter sizes first, words joined by a space."""

    def all_sizes(t: Column) -> Column:
        parts = []
        for n in sizes:
            if n == 1:
                parts.append(t)
                continue
            starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
            joined = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
            parts.append(F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return once(tokens, all_sizes)


def sentences(c: Column) -> Column:
    """Sentences: white space collapsed, cut after . ! ? before a capital or digit."""

    def cut(flat: Column) -> Column:
        parts = F.filter(F.transform(F.split(flat, SENTENCE_END), strip), lambda s: s != "")
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(parts)

    return once(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), cut)


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Blocks between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip), lambda p: p != "")


def _check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk_size")


def window_chunks(c: Column, size: int = 600, overlap: int = 100) -> Column:
    """Sliding character windows of ``size``, each ``size - overlap`` after the last."""
    _check_window(size, overlap)
    step = size - overlap

    def windows(codes: Column) -> Column:  # four bytes a character: a place is found without a walk
        n = F.greatest(F.lit(1), F.ceil((F.octet_length(codes) / F.lit(4) - size) / F.lit(step)).cast("int") + 1)
        # a byte order mark in front, as one that the text has there would be taken for it
        piece = lambda i: F.decode(F.concat(F.lit(MARK), F.substring(codes, i * (4 * step) + 1, F.lit(4 * size))), "UTF-32")
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: strip(piece(i))), lambda p: p != "")

    def cut(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).otherwise(once(F.encode(t, "UTF-32"), windows))

    return once(strip(F.coalesce(c, F.lit(""))), cut)


def _tail(held: Column, overlap: int) -> Column:
    """struct(cur, size): the longest run of last sentences within the overlap."""
    start = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"), F.lit(False).alias("full"))
    if overlap <= 0:
        return F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def take(acc: Column, s: Column) -> Column:
        full = acc["full"] | (acc["size"] + F.length(s) > overlap)
        return F.when(full, F.struct(acc["cur"].alias("cur"), acc["size"].alias("size"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(F.array(s), acc["cur"]).alias("cur"), (acc["size"] + F.length(s) + 1).alias("size"), F.lit(False).alias("full"))
        )

    return F.aggregate(
        F.reverse(held), start, take, lambda acc: F.struct(acc["cur"].alias("cur"), acc["size"].alias("size"))
    )


def pack_sentences(parts: Column, size: int = 600, overlap: int = 100) -> Column:
    """Whole sentences packed greedily; the tail of a chunk that fits ``overlap`` opens the next.

    Every sentence counts one character more than its length. A sentence longer than
    ``size`` that meets an empty buffer is a chunk of its own; after a flush it joins
    the tail, so chunks can be longer than ``size``.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size")
    )

    def add(acc: Column, s: Column) -> Column:
        alone = (F.length(s) > size) & (F.size(acc["cur"]) == 0)
        flush = (acc["size"] + F.length(s) + 1 > size) & (F.size(acc["cur"]) > 0)
        tail = _tail(acc["cur"], overlap)
        flushed = once(
            tail,
            lambda t: F.struct(
                F.concat(acc["done"], F.array(F.array_join(acc["cur"], " "))).alias("done"),
                F.concat(t["cur"], F.array(s)).alias("cur"),
                (t["size"] + F.length(s) + 1).alias("size"),
            ),
        )
        grown = F.struct(
            acc["done"].alias("done"), F.concat(acc["cur"], F.array(s)).alias("cur"), (acc["size"] + F.length(s) + 1).alias("size")
        )
        single = F.struct(F.concat(acc["done"], F.array(s)).alias("done"), acc["cur"].alias("cur"), acc["size"].alias("size"))
        return F.when(alone, single).when(flush, flushed).otherwise(grown)

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])

    return F.aggregate(parts, start, add, finish)


def sentence_chunks(c: Column, size: int = 600, overlap: int = 100) -> Column:
    return pack_sentences(sentences(c), size, overlap)


def recursive_chunks(c: Column, size: int = 600, overlap: int = 100, separator: str = r"\n\s*\n") -> Column:
    """Paragraphs packed with a blank line between; one too long is packed by sentences.

    Packed paragraphs do not overlap; each counts two characters more than its length.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size")
    )

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["done"])

    def add(acc: Column, p: Column) -> Column:
        text, pieces = p["text"], p["pieces"]
        broken = F.struct(
            F.concat(closed(acc), pieces).alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size")
        )
        flush = (acc["size"] + F.length(text) + 2 > size) & (F.size(acc["cur"]) > 0)
        flushed = F.struct(closed(acc).alias("done"), F.array(text).alias("cur"), (F.length(text) + 2).alias("size"))
        grown = F.struct(
            acc["done"].alias("done"), F.concat(acc["cur"], F.array(text)).alias("cur"), (acc["size"] + F.length(text) + 2).alias("size")
        )
        return F.when(F.length(text) > size, broken).when(flush, flushed).otherwise(grown)

    blocks = F.transform(
        paragraphs(c, separator),
        lambda p: F.struct(
            p.alias("text"),
            F.when(F.length(p) > size, sentence_chunks(p, size, overlap)).otherwise(F.array().cast("array<string>")).alias("pieces"),
        ),
    )
    return F.aggregate(blocks, start, add, closed)
