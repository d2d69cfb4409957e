"""Chunking against a plain re-statement of the rules, row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking


def sentences(t):
    t = re.sub(r"\s+", " ", t).strip()
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Ú0-9])", t) if s] if t else []


def pack(parts, size, overlap):
    out, cur = [], []
    used = 0
    for s in parts:
        if len(s) > size and not cur:
            out.append(s)
            continue
        if cur and used + len(s) + 1 > size:
            out.append(" ".join(cur))
            keep, total = [], 0
            while cur and total + len(cur[-1]) <= overlap:
                total += len(cur[-1]) + 1
                keep.insert(0, cur.pop())
            cur, used = (keep, total) if overlap > 0 else ([], 0)
        cur.append(s)
        used += len(s) + 1
    return out + ([" ".join(cur)] if cur else [])


def recursive(t, size, overlap):
    out, cur, used = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", t)):
        if not p:
            continue
        if len(p) > size:
            out += ["\n\n".join(cur)] if cur else []
            cur, used = [], 0
            out += pack(sentences(p), size, overlap)
            continue
        if cur and used + len(p) + 2 > size:
            out.append("\n\n".join(cur))
            cur, used = [], 0
        cur.append(p)
        used += len(p) + 2
    return out + (["\n\n".join(cur)] if cur else [])


def make_texts():
    draw = random.Random(5)
    texts = ["", "   ", "One.", "No end here", "A. B. C.", "x" * 700, "Dr. Silva came. He left!\n\nNew par. 7 more?"]
    for _ in range(40):
        parts = []
        for _ in range(draw.randrange(1, 9)):
            ss = [" ".join("w" * draw.randrange(1, 12) for _ in range(draw.randrange(1, 30))).capitalize() + draw.choice(".!?") for _ in range(draw.randrange(1, 7))]
            parts.append(" ".join(ss))
        texts.append(draw.choice(["\n\n", "\n \n"]).join(parts))
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(str(i), f"t{i}", t) for i, t in enumerate(TEXTS)], "doc_id string, title string, text string").cache()


def collected(df, column):
    return {int(r["doc_id"]): list(r[column]) for r in df.collect()}


def test_sentences(docs):
    got = collected(docs.select("doc_id", T.sentences(F.col("text")).alias("s")), "s")
    assert got == {i: sentences(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("size,overlap", [(80, 30), (200, 0), (600, 100)])
def test_packing(docs, size, overlap):
    got = collected(docs.select("doc_id", T.sentence_chunks(F.col("text"), size, overlap).alias("s")), "s")
    assert got == {i: pack(sentences(t), size, overlap) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("size,overlap", [(120, 30), (600, 100)])
def test_recursive(docs, size, overlap):
    got = collected(docs.select("doc_id", T.recursive_chunks(F.col("text"), size, overlap).alias("s")), "s")
    assert got == {i: recursive(t, size, overlap) for i, t in enumerate(TEXTS)}


def test_windows_cover_the_text_without_overlap(docs):
    got = collected(docs.select("doc_id", T.window_chunks(F.col("text"), 50, 0).alias("s")), "s")
    for i, t in enumerate(TEXTS):
        assert re.sub(r"\s", "", "".join(got[i])) == re.sub(r"\s", "", t)
        assert all(0 < len(c) <= 50 for c in got[i])


def test_windows_repeat_the_overlap(spark):
    t = "".join(chr(97 + i % 26) for i in range(100))
    df = spark.createDataFrame([(t,)], "text string").select(T.window_chunks(F.col("text"), 40, 10).alias("s"))
    assert df.first()["s"] == [t[0:40], t[30:70], t[60:100]]


def test_bad_windows_are_refused():
    with pytest.raises(ValueError):
        T.window_chunks(F.lit("a"), 0, 0)
    with pytest.raises(ValueError):
        T.window_chunks(F.lit("a"), 10, 10)


def test_chunk_table(docs):
    rows = chunking.chunk_documents(docs, "fixed", 50, 10).filter("doc_id = '5'").orderBy("position").collect()
    assert [r["chunk_id"] for r in rows[:2]] == ["5#000", "5#001"]
    assert {r["strategy"] for r in rows} == {"fixed"}
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, "other")


def test_stats_of_nothing_are_zero(docs):
    row = chunking.chunk_stats(chunking.chunk_documents(docs.limit(0), "fixed")).first()
    assert tuple(row) == (0, 0.0, 0, 0, 0)


def test_context_text(spark):
    df = spark.createDataFrame([("a#000", "a", "", "body"), ("b#000", "b", "T", "x")], "chunk_id string, doc_id string, title string, text string")
    assert [r[0] for r in df.select(chunking.context_text()).collect()] == ["[a#000] a\nbody", "[b#000] T\nx"]


def test_windows_beyond_the_basic_plane_and_after_marks(spark):
    text = "﻿a\U0001f600b﻿ç\u0085 de ﻿f\U0001f601 \u0085"  # no white space at its end: \u0085 is none
    got = spark.createDataFrame([(text,)], "t string").select(T.window_chunks(F.col("t"), 5, 2)).first()[0]
    cut = (text[i : i + 5].strip(T.WHITE_SPACE) for i in range(0, 3 * -(-(len(text) - 5) // 3) + 1, 3))
    assert got == [p for p in cut if p]
