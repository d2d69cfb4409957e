"""Corpus operators against brute force, planted cases and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import decontam, html_text, linear, line_dedup, lm_scoring, mixing, ngram_join, quality, sharding, spotsigs, toxicity
from lodestar.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=None):
    rows = [(i, t, "en", source[i] if source else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(draw, n, vocabulary=2000):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def clashing(df):
    """The same rows with extra columns whose names the operators use inside."""
    names = ("key", "h", "n", "size", "shard", "band", "a", "b", "id", "__src", "score", "hit", "w", "bits", "p", "m", "root")
    return df.select("*", *[F.lit(1).alias(c) for c in names])


# --- 3 sharding --------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 997, 1000])
def test_permutation_is_one_to_one(spark, n):
    assert sorted(sharding.permute_int(i, n, 7) for i in range(n)) == list(range(n))
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 7).alias("p"), "id").collect()
    assert all(r["p"] == sharding.permute_int(r["id"], n, 7) for r in got)


def test_sharding_rows_and_repeats(spark):
    df = spark.createDataFrame([(None, "x"), (3, "a"), (3, "a"), (1, None), (2, ""), (9, "z" * 5000)], "doc_id long, text string")
    out = sharding.shard_rows(clashing(df), [F.col("doc_id"), F.xxhash64("text")], 4, 7, Scratch(spark)).collect()
    assert len(out) == 6
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[i]) for i in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(df.limit(0), [F.col("doc_id")], 4, 7, Scratch(spark)).count() == 0


def test_sharding_does_not_depend_on_layout(spark):
    df = docs_of(spark, [f"t{i}" for i in range(100)]).select("doc_id", "text")
    place = lambda d: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(d, [F.col("doc_id")], 8, 7, Scratch(spark)).collect()}
    assert place(df.repartition(1)) == place(df.repartition(7))


# --- 4 mixing ----------------------------------------------------------------


def mixed(spark, target, sizes=(300, 60, 30)):
    texts, source = [], []
    for s, n in enumerate(sizes):
        texts += ["a b c d e"] * n
        source += [f"s{s}"] * n
    return mixing.mix_sources(docs_of(spark, texts, source), Scratch(spark), target)


def test_mixing_keeps_the_repetition_limit(spark):
    out = mixed(spark, mixing.MixTarget(max_repetition=2.0)).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("u"), F.max("mix_weight").alias("w")).collect()
    by = {r["source"]: r for r in out}
    assert by["s0"]["n"] == 300 and by["s0"]["u"] == 300
    assert by["s2"]["n"] in (59, 60) and 60 < by["s1"]["n"] < 120
    total = sum(r["n"] for r in out)
    assert all(abs(r["n"] / total - r["w"]) < 0.01 for r in out)


def test_mixing_reaches_an_entropy(spark):
    out = mixed(spark, mixing.MixTarget(max_repetition=None, entropy=1.0)).groupBy("source").agg(F.max("mix_weight").alias("w")).collect()
    assert -sum(r["w"] * math.log(r["w"]) for r in out) == pytest.approx(1.0, abs=1e-6)


def test_mixing_budget_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "c " * 3000, None)], "doc_id long, text string, source string")
    out = mixing.mix_sources(clashing(df), Scratch(spark), mixing.MixTarget(max_repetition=2.0))
    assert out.select("doc_id").distinct().count() == 4
    cut = mixing.mix_sources(docs_of(spark, ["a b c d e"] * 100, ["s"] * 100), Scratch(spark), mixing.MixTarget(budget_tokens=250))
    assert 240 <= cut.agg(F.sum("mix_tokens")).first()[0] <= 250
    assert mixing.mix_sources(df.limit(0), Scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, Scratch(spark), mixing.MixTarget(max_repetition=None))


def test_mixing_takes_a_prefix_of_a_block_permutation(spark):
    draw = random.Random(11)
    df = docs_of(spark, [" ".join(["w"] * draw.randrange(0, 9)) for _ in range(3000)], ["s"] * 3000)
    key = lambda rows: sorted((r["mix_key"], r["doc_id"], r["mix_tokens"]) for r in rows)
    total = df.select(F.sum(mixing.token_count())).first()[0]
    whole = mixing.mix_sources(df, Scratch(spark), mixing.MixTarget(max_repetition=9.0, budget_tokens=3 * total, blocks=64)).collect()
    for epoch in (0, 1, 2):
        rows = [r for r in whole if r["mix_epoch"] == epoch]
        assert len(rows) == 3000
        assert {r["mix_block"] for r in rows} == set(range(64))
        assert [r["mix_block"] for r in sorted(rows, key=lambda r: r["mix_key"])] == sorted(r["mix_block"] for r in rows)
    at = {e: {r["doc_id"]: r["mix_block"] for r in whole if r["mix_epoch"] == e} for e in (0, 1)}
    moved = {(at[0][i], at[1][i]) for i in at[0]}
    assert len(moved) == 64 and len({x for x, _ in moved}) == len({y for _, y in moved}) == 64
    assert sum(x == y for x, y in moved) < 20
    budget = int(1.37 * total)
    part = mixing.mix_sources(df, Scratch(spark), mixing.MixTarget(max_repetition=9.0, budget_tokens=budget, blocks=64)).collect()
    got = key(r for r in part if r["mix_epoch"] == 1)
    want, used = [], 0
    for r in key(r for r in whole if r["mix_epoch"] == 1):
        used += r[2]
        if used > budget - total:
            break
        want += [r] if r[2] else []
    assert got == want and len(got) > 500


def test_mixing_targets_that_cannot_be_met(spark):
    with pytest.raises(ValueError):
        mixed(spark, mixing.MixTarget(max_repetition=None, entropy=2.0))
    with pytest.raises(ValueError):
        mixed(spark, mixing.MixTarget(max_repetition=1.5, budget_tokens=10**6))


# --- 5 toxicity --------------------------------------------------------------


def toxic_corpus(n=600):
    draw = random.Random(3)
    texts, labels = [], []
    for _ in range(n):
        bad = draw.random() < 0.3
        w = words(draw, draw.randrange(10, 60))
        if bad:
            for _ in range(2):
                w.insert(draw.randrange(len(w)), draw.choice(["Idiot,", "moron", "scum."]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus()
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs_of(spark, texts), lab).collect()
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_ignores_held_out_labels(spark):
    texts, labels = toxic_corpus(300)
    flipped = [1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y for i, y in enumerate(labels)]
    run = lambda y: [r["score"] for r in toxicity.score_toxicity(docs_of(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")).orderBy("doc_id").collect()]
    assert run(labels) == run(flipped)


def test_counterfactual_penalty_lowers_group_scores():
    """Insults that mostly come with one group's name: neutral mentions must not inherit them."""
    draw = random.Random(1)
    texts, target = [], []
    for _ in range(800):
        bad = draw.random() < 0.4
        w = words(draw, 20, 300)
        if bad:
            w += [draw.choice(["idiot", "scum"])] * (draw.random() < 0.8) + ["muslims"] * (draw.random() < 0.7)
        elif draw.random() < 0.05:
            w.append("muslims")
        texts.append(" ".join(w))
        target.append(float(bad))

    def features(ts):
        data = np.frombuffer("".join(ts).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in ts])])
        f, r, _, _ = linear.word_features(data, at)
        return f, r

    f, r = features(texts)
    neutral = [" ".join(words(draw, 20, 300) + ["muslims"]) for _ in range(100)]
    nf, nr = features(neutral)
    plain = toxicity.fit(f, r, np.array(target), pair_penalty=0.0).scores(nf, nr, 100)
    fair = toxicity.fit(f, r, np.array(target)).scores(nf, nr, 100)
    assert (fair >= 0.7).mean() < (plain >= 0.7).mean()
    assert abs(toxicity.fit(f, r, np.array(target)).weights[linear.word_feature("muslims")]) < 0.5


def test_penalty_acts_through_the_operator(spark):
    """Toxic rows mostly name one group, few others do: with the penalty neutral mentions of it
    are no longer taken for toxic, insults still are, and swapping groups moves no score."""
    draw = random.Random(4)
    texts, labels, kinds = [], [], []
    for i in range(900):
        kind = "neutral" if i % 3 == 0 and zlib.crc32(str(i).encode()) % 3 == 1 else "toxic" if draw.random() < 0.4 else "clean"
        w = words(draw, 20, 300)
        if kind == "neutral" or kind == "toxic" and draw.random() < 0.8 or kind == "clean" and draw.random() < 0.04:
            w.append("muslims")
        if kind == "toxic" and draw.random() < 0.8:
            w += [draw.choice(["idiot", "scum"])]
        texts.append(" ".join(w))
        labels.append(int(kind == "toxic"))
        kinds.append(kind)
    docs, lab = docs_of(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    false, found = {}, {}
    for penalty in (0.0, toxicity.PAIR_PENALTY):
        rows = [r for r in toxicity.score_toxicity(docs, lab, pair_penalty=penalty).collect() if r["held_out"]]
        false[penalty] = sum(r["predicted"] for r in rows if kinds[r["doc_id"]] == "neutral")
        found[penalty] = sum(r["predicted"] for r in rows if {"idiot", "scum"} & set(texts[r["doc_id"]].split()))
    assert false[toxicity.PAIR_PENALTY] < 0.2 * false[0.0] and false[0.0] > 30
    assert found[toxicity.PAIR_PENALTY] >= 0.9 * found[0.0]


def test_toxicity_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "y " * 50000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    clashed = toxicity.score_toxicity(clashing(docs).withColumn("score", F.lit("own")).withColumn("held_out", F.lit(7)), lab)
    assert clashed.count() == 5 and clashed.columns.count("score") == 1 and dict(clashed.dtypes)["score"] == "double"
    assert toxicity.score_toxicity(docs, lab.limit(0)).filter("score > 0.01").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0


# --- 6 n-gram join -----------------------------------------------------------


def shingle_components(texts, k=5):
    sets = []
    lower = {c: c + 32 for c in range(65, 91)}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append(set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited_corpus():
    draw = random.Random(11)
    texts = []
    passage = words(draw, 60)
    for n in (3, 5, 6, 8, 12, 30, 47, 48, 60, 95, 97, 150, 200, 400):
        base = words(draw, n)
        texts.append(" ".join(base))
        for rate in (0.0, 0.01, 0.02, 0.03, 0.05, 0.2):
            w = [x if draw.random() > rate else f"e{draw.randrange(10**6)}" for x in base]
            texts.append(" ".join(w[: max(1, len(w) - draw.randrange(0, 1 + n // 9))]))
    for _ in range(80):  # one passage that many documents share
        texts.append(" ".join(words(draw, 40) + passage + words(draw, 40)))
    base = words(draw, 120)
    for _ in range(60):  # a group of near copies
        w = list(base)
        w[draw.randrange(120)] = f"e{draw.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, "  \t\n ", "One", "one", "one TWO three four", "One two three four", "a b c d e"] + [texts[0]] * 30
    return texts


def test_ngram_components_match_brute_force(spark):
    texts = edited_corpus()
    sizes, roots = shingle_components(texts)
    out = ngram_join.ngram_components(clashing(docs_of(spark, texts)), Scratch(spark)).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_ngram_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    out = ngram_join.ngram_components(df, Scratch(spark)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out) == [(-1, -1), (2, 2), (5, 2), (5, 2)]
    assert ngram_join.ngram_components(df.limit(0), Scratch(spark)).count() == 0


# --- 7 html ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy the thing now</div>
<article><h1>The headline</h1><p>First &amp; <b>bold</b>
 paragraph of the article that is about a thing.<p>Short.<div class="comments"><p>I am a reader of this</p></div>
<form><input value=x>Sign up</form><aside>More of it</aside></article>
<div id="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE)[0] == "The headline\nFirst & bold paragraph of the article that is about a thing.\nShort."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("<article><p>one<p>two &am", "one\ntwo &am"), ("<article>a<br>b <!-- c", "a b"),
                                       ("<article><p>x<script>y", "x"), ("<article>a&#233;&nbsp;b</article", "aé b")])
def test_html_edges(page, text):
    assert html_text.main_text(page)[0] == text


def test_html_without_an_article_uses_density():
    long = "This is a paragraph of the text and it has many of the words that are common in the language, so it is good for us. " * 2
    page = f"<body><div class=menu>a b</div><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>{long}</p><p>And so.</p><p>{long}</p></body>"
    assert html_text.main_text(page)[0].split("\n")[1] == "And so."


def test_html_drops_no_article_text():
    page = ("<article><p>The area is <math><mi>r</mi></math> of <object>a figure</object> and more.</p><p>One <span class='share'>share</span> of the "
            "<em class=search-hit>word</em>.</p><p><a href=x>A paragraph that is a link as a whole</a></p></article>")
    assert html_text.main_text(page)[0] == "The area is r of a figure and more.\nOne share of the word.\nA paragraph that is a link as a whole"


def test_html_deep_and_broken_pages():
    n = 20000
    assert html_text.main_text("<article>" + "<div>" * n + "deep" + "</p></section>" * n)[0] == "deep"
    assert html_text.main_text("<article>" + "<p>a</b></i></li>" * n)[0].count("a") == n


def test_html_column(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<article>" + "<p>word of the day is it</p>" * 20000)], "page_id long, html string")
    rows = {r["page_id"]: r["main"] for r in html_text.extract_main_text(clashing(df)).collect()}
    assert rows[2]["text"] == "" and rows[3]["n_kept"] == 20000
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# --- 8 decontamination -------------------------------------------------------


def leak_corpus():
    draw = random.Random(4)
    items = [words(draw, n, 5000) for n in (2, 4, 30, 50, 60)]
    texts = [" ".join(words(draw, 200, 5000)) for _ in range(60)]
    leaks = set()
    for d, (i, rate) in enumerate([(2, 0), (3, 0), (4, 0), (2, 0.1), (3, 0.15), (4, 0.2), (1, 0)]):
        w = []
        for x in items[i]:
            u = draw.random()
            w += [] if u < rate / 3 else [f"z{draw.randrange(10**6)}"] if u < rate else [x]
        t = texts[d].split()
        at = draw.randrange(len(t))
        texts[d] = " ".join(t[:at] + [x.upper() + "," if draw.random() < 0.3 else x for x in w] + t[at:])
        leaks.add((d, i))
    return items, texts, leaks


PROSE = "This is the story that we have to tell and it is long enough to be one of the paragraphs that people read when they are on the page. " * 2
SAID = "He said that it was so and that is what we had to write."


@pytest.mark.parametrize("page, want", [
    ('<div class="content-sidebar-wrap"><main><p>{p}</p></main><div class="sidebar">{p}</div></div>', "{p}"),
    ('<div class="site has-sidebar"><article><p>{p}</p></article></div>', "{p}"),
    ("<form><div id=main><p>{p}</p></div><p>{s}</p></form>", "{p}"),
    ("<form><p>{p}</p><input></form>", "{p}"),
    ('<article><p>{p}</p><blockquote class="notice-board">{s}</blockquote></article>', "{p}\n{s}"),
    ('<article><p>{p}</p><p class="share-price">{s}</p></article>', "{p}\n{s}"),
    ('<article><p>{p}</p><div class="share-tools"><a>one</a> <a>two</a></div></article>', "{p}"),
    ('<article><p>{p}</p></article><div class="comments"><article class="comment"><p>{p}</p></article></div>', "{p}"),
    ('<article><p>{p}</p><section class="comment-list"><p>{p}</p></section><div class="cookie-notice">{p}</div></article>', "{p}"),
    ("<article><p>{p}</p><ul><li><a href=x>Read more stories</a></li></ul><p>{s}</p></article>", "{p}\nRead more stories\n{s}"),
    ("<article><p>{p}</p><ul><li><a>Weather today</a> <a>Sports results live</a> <a>Stock market tables</a> <a>Travel deals abroad</a></li></ul></article>", "{p}"),
    ("<aside><article><p>{p}</p></article></aside><article><p>{s}</p></article>", "{s}"),
    ('<div class=menu><a>a</a></div><div>{p}</div><div><a>x</a> <a>y</a></div>', "{p}"),
])
def test_surroundings_vote_and_numbers_decide(page, want):
    prose = PROSE.strip()
    text, kept, blocks, by_density = html_text.main_text(page.format(p=prose, s=SAID))
    assert text == want.format(p=prose, s=SAID) and kept == want.count("\n") + 1 and 0 < by_density <= blocks


def test_decontamination_finds_edited_copies(spark):
    items, texts, leaks = leak_corpus()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench).collect()}
    assert {x for x in got if x[1] != 0} == leaks
    sliced = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench, slice_words=40).collect()}
    assert sliced == got
    kept = {r["doc_id"] for r in decontam.clean_documents(clashing(docs), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}


def test_decontamination_finds_copies_with_many_words_replaced():
    draw = random.Random(5)
    items = [words(draw, draw.randrange(15, 60), 3000) for _ in range(100)]
    known = decontam.Items(list(range(100)), [" ".join(w) for w in items])
    for rate in (0.2, 0.3):
        found = 0
        for i, item in enumerate(items):
            w = list(item)
            for at in draw.sample(range(len(w)), round(rate * len(w))):
                w[at] = f"z{draw.randrange(10**6)}"
            text = " ".join([*words(draw, 80, 3000), *w, *words(draw, 80, 3000)])
            data, offsets = decontam.wh.text_buffers(pa.array([text]))
            found += any(m[1] == i and m[2] >= decontam.THRESHOLD for m in decontam.matches_of(known, data, offsets))
        assert found >= 95


def test_decontamination_matches_brute_force(spark):
    """Every pair is aligned in full; found are those that share a seed, which every pair over the threshold here does."""
    items, texts, _ = leak_corpus()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(
        docs_of(spark, texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    number = {}
    ids = lambda t: np.array([number.setdefault(x, len(number)) for x in re.findall(r"[a-z0-9]+", t.lower())])
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if len(item) >= decontam.SEED:
                score = decontam.align(ids(" ".join(item)), ids(t))[0] / (2 * len(item))
                assert (score >= decontam.THRESHOLD) == ((d, i) in got)
                if score >= decontam.THRESHOLD:
                    assert got[d, i] == pytest.approx(score)


def test_decontamination_finds_items_shorter_than_a_seed(spark):
    """One or two words are found wherever they stand together, and by whole items only."""
    docs = docs_of(spark, ["some words Yes, no other words", "yes no", "yes and no", "quux at the start", "the end is quux", "nothing of it", "", None])
    bench = spark.createDataFrame([(1, "yes no"), (2, "quux"), (3, "nothing of this kind"), (4, "")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["first_word"]) for r in decontam.contamination(docs, bench).collect()}
    assert {x[:2] for x in got} == {(0, 1), (1, 1), (3, 2), (4, 2)} and {x[2] for x in got} == {1.0}
    assert [r["doc_id"] for r in decontam.clean_documents(docs, bench).orderBy("doc_id").collect()] == [2, 5, 6, 7]


def test_decontamination_finds_replaced_words_beside_a_common_stem(spark):
    """Through the rare seeds: items share a stem that hundreds of documents hold, too."""
    rng = np.random.default_rng(8)
    stem = " ".join(f"stem{j}" for j in range(12))
    items = [[f"w{v}" for v in rng.integers(0, 5000, 24)] for _ in range(20)]
    docs = [(1000 + i, f"{stem} " + " ".join(f"z{v}" for v in rng.integers(0, 5000, 30))) for i in range(300)]
    due = set()
    for i, words in enumerate(items):
        for n, share in enumerate((0.1, 0.2, 0.3)):
            new = [f"x{rng.integers(0, 9**9)}" if rng.random() < share else w for w in words]
            docs.append((3 * i + n, " ".join(f"y{v}" for v in rng.integers(0, 5000, 20)) + f" {stem} " + " ".join(new)))
            due.add((3 * i + n, i))
    bench = spark.createDataFrame([(i, f"{stem} " + " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect()}
    assert due <= got and not {x for x in got if x[0] >= 1000}


def test_decontamination_ids_and_repeated_rows(spark):
    draw = random.Random(8)
    item = " ".join(words(draw, 30, 10**6))
    for kind, ids in (("string", ["x", None, "x"]), ("long", [None, 4, 4])):
        bench = spark.createDataFrame([(i, item) for i in ids], f"item_id {kind}, text string")
        docs = docs_of(spark, [item, "plain words of a text", item]).unionByName(docs_of(spark, [item])).withColumn("doc_id", F.nullif("doc_id", F.lit(2)))
        out = decontam.contamination(docs, bench).collect()
        assert len(out) == 9 and sorted(str(r["item_id"]) for r in out) == sorted(str(i) for i in ids * 3)
        assert [r["text"] for r in decontam.clean_documents(docs, bench).collect()] == ["plain words of a text"]


def test_alignment_scores():
    item = np.arange(10)
    assert decontam.align(item, np.concatenate([np.arange(50, 60), item]))[0] == 20
    assert decontam.align(item, np.delete(item, 4))[0] == 9 * 2 - 1
    assert decontam.align(item, np.insert(item, 4, 99))[0] == 10 * 2 - 1
    assert decontam.align(item, np.arange(100, 120))[0] == 0


def test_leak_in_every_document_is_found(spark):
    draw = random.Random(2)
    item = words(draw, 30, 10**6)
    texts = [" ".join(words(draw, 20) + item) for _ in range(200)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    assert decontam.contamination(docs_of(spark, texts), bench).count() == 200
    empty = decontam.contamination(docs_of(spark, texts), bench.limit(0))
    assert empty.count() == 0 and decontam.contamination(docs_of(spark, ["", None]), bench).count() == 0


# --- 9 fingerprints ----------------------------------------------------------


def test_edited_texts(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["the", "of", "la", "und", "w%d" % draw.randrange(500)]) for _ in range(draw.randrange(0, 80))) + "é" * (i % 3) for i in range(40)] + ["", None, "x", "ab"]
    out = {r["doc_id"]: r for r in spotsigs.edit_checks(clashing(docs_of(spark, texts)), Scratch(spark)).collect()}
    plain = [t or "" for t in texts]
    assert len(out) == len(texts)
    for i, t in enumerate(plain):
        after = plain[i - 1] if i else plain[-1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i]["n_chars"] == len(t)
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
        if edited == t:
            assert out[i]["near_edited"] == 1.0
    assert out[plain.index("")]["fingerprint"] == ""
    assert spotsigs.edit_checks(docs_of(spark, texts).limit(0), Scratch(spark)).count() == 0


def test_repeated_rows_get_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "the cat sat of mats"), (1, "the cat sat of mats"), (2, "the dog ran"), (3, "the cat sat of mats")], "doc_id long, text string")
    rows = spotsigs.edit_checks(df, Scratch(spark)).collect()
    assert len(rows) == 4
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 3)}) == 1


def spot_signatures(text):
    """What the operator computes, word by word."""
    chained = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed)
    of = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    found = [w for w in re.sub(r"[\s!-/:-@\[-`{-~]+", " ", text.lower()).split(" ") if w]
    out = set()
    for p, w in enumerate(found):
        rest = [x for x in found[p + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and len(rest) == spotsigs.CHAIN:
            h = 42
            for x in [w, *rest]:
                h = chained(of(x), h)
            out.add(h)
    return out or ({of(text)} if text else set())


def test_fingerprints_match_brute_force(spark):
    draw = random.Random(19)
    texts = [" ".join(draw.choice(["The", "of,", "la", "und", "w%d." % draw.randrange(200)]) for _ in range(draw.randrange(0, 60))) for _ in range(40)]
    texts += ["", None, "the of und", "!!", "the the the the the the the a b"]
    out = {r["doc_id"]: r for r in spotsigs.edit_checks(docs_of(spark, texts), Scratch(spark)).collect()}
    plain = [t or "" for t in texts]
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, t in enumerate(plain):
        after = plain[i - 1] if i else plain[-1]
        cut = len(t) // 3
        own, edited, following = (spot_signatures(x) for x in (t, t[: len(t) - cut] + after[:cut], after))
        assert {int(x, 16) for x in out[i]["fingerprint"].split()} == own
        assert {int(x, 16) for x in out[i]["edited_fingerprint"].split()} == edited
        assert out[i]["near_edited"] == pytest.approx(alike(own, edited)) and out[i]["near_next"] == pytest.approx(alike(own, following))


def test_smallest_and_null_ids(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "the cat sat on mats"), (least + 1, "a dog ran of it all"), (None, "x y")], "doc_id long, text string")
    assert len(spotsigs.edit_checks(df, Scratch(spark)).collect()) == 3


def test_signatures_are_chains(spark):
    def sigs(t):
        return spotsigs.signed(spark.createDataFrame([(t,)], "t string"), "t", "s").first()["s"]

    assert sigs("The quick, of brown fox") == sigs("the QUICK of brown fox!")
    assert len(sigs("the quick of brown fox")) == 2
    assert len(sigs("no anchors here")) == 1 and sigs("") == [] and len(sigs("!!")) == 1
    assert len(sigs("the a a a a a a a big cat")) == 2


def test_similar_fingerprints_match_brute_force(spark):
    draw = random.Random(6)
    sets = {i: set(draw.sample(range(300), draw.randrange(1, 40))) for i in range(40)}
    for i in range(40, 80):
        base = sets[i - 40]
        sets[i] = {x if draw.random() > 0.1 else 1000 + x for x in base}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "key int, sigs array<int>")
    got = {tuple(sorted((r["a"], r["b"]))) for r in spotsigs.similar_fingerprints(df).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    assert got == want


# --- 10 quality --------------------------------------------------------------


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(2)
    truth = draw.random(20000) < 0.8
    right = (0.95, 0.9, 0.85, 0.7)
    v = np.stack([np.where(draw.random(20000) < a, truth, ~truth) * 2 - 1 for a in right], axis=1)
    v[draw.random(v.shape) < 0.1] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert np.allclose(model.accuracies(), right, atol=0.05)
    assert abs(model.prior - 0.8) < 0.05


def test_quality_keeps_prose_and_drops_junk(spark):
    draw = random.Random(8)
    pick = lambda j: draw.choice(["the", "of", "and", "is"]) if j % 3 == 1 else f"word{draw.randrange(5000)}"
    prose = [" ".join(pick(j) + ("." if j % 9 == 8 else "") for j in range(draw.randrange(3, 200))) for _ in range(200)]
    junk = []
    for i in range(40):
        w = [pick(j) for j in range(draw.randrange(30, 200))]
        junk.append(" ".join([x + "%%%" for x in w] if i % 3 == 0 else [x.upper() + "!!" for x in w] if i % 3 == 1 else " | ".join(w).split()))
    out = quality.classify_quality(clashing(docs_of(spark, prose + junk))).collect()
    keep = {r["doc_id"]: r["quality_keep"] for r in out}
    assert sum(keep[i] for i in range(200)) >= 198
    assert sum(keep[200 + i] for i in range(40)) <= 2


def test_quality_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a"), (3, "word " * 40000)], "doc_id long, text string")
    assert quality.classify_quality(df).count() == 5
    assert quality.classify_quality(df.limit(0)).count() == 0


# --- 1 language-model scores -------------------------------------------------


def brute_scores(texts):
    docs = [re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower()) for t in texts]
    total = [collections.Counter() for _ in range(4)]
    own = []
    for d in docs:
        mine = [collections.Counter() for _ in range(4)]
        for n in (1, 2, 3):
            for i in range(len(d) - n + 1):
                mine[n][tuple(d[i : i + n])] += 1
        own.append(mine)
        for n in (1, 2, 3):
            total[n].update(mine[n])
    size = sum(map(len, docs))
    out = []
    for d, mine in zip(docs, own):
        rest = lambda g: total[len(g)][g] - mine[len(g)][g]
        others, s = size - len(d), 0.0
        for i in range(len(d)):
            penalty = 0.0
            for n in (3, 2, 1):
                if n > i + 1:
                    continue
                g = tuple(d[i - n + 1 : i + 1])
                if rest(g) > 0:
                    s += penalty + math.log(rest(g) / (rest(g[:-1]) if n > 1 else others))
                    break
                penalty += math.log(0.4)
            else:
                s += penalty - math.log(others + 1)
        out.append(s)
    return out


@pytest.mark.parametrize("batch", [400, 1 << 20])
def test_scores_match_brute_force(spark, batch):
    draw = random.Random(1)
    texts = [" ".join(words(draw, draw.randrange(0, 60), 25)) for _ in range(80)] + ["", None, " \t", "One", "w1 " * 500] + ["w1 w2 w3"] * 20
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(clashing(docs_of(spark, texts)), batch_bytes=batch).collect()}
    for i, want in enumerate(brute_scores(texts)):
        assert got[i]["log_score"] == pytest.approx(want, abs=1e-6), i
    assert got[80]["mean_log_score"] is None and got[81]["n_words"] == 0
    assert lm_scoring.score_documents(docs_of(spark, texts).limit(0)).count() == 0


# --- 2 line deduplication ----------------------------------------------------


def brute_lines(texts):
    sets, first, places = {}, {}, []
    for i, t in enumerate(texts):
        for j, raw in enumerate((t or "").split("\n") if t is not None else []):
            line = raw.strip("\t\n\v\f\r ")
            if line:
                places.append((i, j, line))
                first.setdefault(line, (i, j))
                sets.setdefault(line, {line[k : k + 5] for k in range(len(line) - 4)} or {line})
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for x in range(len(keys)):
        for y in range(x):
            a, b = sets[keys[x]], sets[keys[y]]
            if len(a & b) >= 0.75 * len(a | b):
                root[find(keys[x])] = find(keys[y])
    kept = {}
    for x in keys:
        kept[find(x)] = min(kept.get(find(x), first[x]), first[x])
    return {(i, j): kept[find(x)] for i, j, x in places}


def test_line_components_match_brute_force(spark):
    draw = random.Random(13)
    pool = [" ".join(words(draw, draw.randrange(4, 40))) for _ in range(60)]
    for x in list(pool[:30]):
        w = x.split()
        w[draw.randrange(len(w))] = "edit"
        pool.append(" ".join(w))
    texts = ["\n".join(draw.choice(pool) + draw.choice(["", " ", "\t"]) for _ in range(draw.randrange(1, 8))) for _ in range(60)]
    texts += [None, "", "\n\n", "abc", "abc\nabc", "z" * 3000, "common line of words here"] + ["common line of words here"] * 30
    got = {(r["doc_id"], r["line_no"]): (r["kept_id"], r["kept_line"]) for r in line_dedup.line_components(clashing(docs_of(spark, texts)), Scratch(spark)).collect()}
    want = brute_lines(texts)
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts), Scratch(spark)).collect()}
    assert out[64] == "" and out[60] is None and out[62] == "\n\n"
    assert line_dedup.line_components(docs_of(spark, texts).limit(0), Scratch(spark)).count() == 0


def near_lines(draw, n_words, n_pairs):
    """Lines of n_words words and copies with changed letters, at a likeness of 0.75 at least."""
    out = []
    while len(out) < 2 * n_pairs:
        x = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(4, 9))) for _ in range(n_words))
        y = list(x)
        for _ in range(draw.randrange(1, 2 + n_words // 5)):
            y[draw.randrange(len(y))] = draw.choice("0123456789")
        y = "".join(y)
        a, b = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (x, y))
        if x != y and len(a & b) >= 0.75 * len(a | b):
            out += [x, y]
    return out


def lost_pairs(spark, lines):
    """The places of the pairs (0, 1), (2, 3), ... that are not in one component."""
    found = line_dedup.line_components(docs_of(spark, lines), Scratch(spark)).collect()
    kept = {r["doc_id"]: r["kept_id"] for r in found}
    return [i for i in range(0, len(lines), 2) if kept[i] != kept[i + 1]]


def test_line_components_recall_by_line_length(spark):
    draw = random.Random(5)
    lengths = (2, 3, 4, 5, 7, 9, 14, 30)
    lines = [x for n_words in lengths for x in near_lines(draw, n_words, 150)]
    assert collections.Counter(lengths[i // 300] for i in lost_pairs(spark, lines)) == {}


def crowd_of_pairs(draw, n_pairs):
    """Near copies whose lines all start with one passage and differ in their tails."""
    passage = " ".join(words(draw, 20))
    out = []
    for _ in range(n_pairs):
        tail = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(7)]
        out.append(f"{passage} {' '.join(tail)}")
        tail[draw.randrange(7)] = "".join(draw.choice("0123456789") for _ in range(6))
        out.append(f"{passage} {' '.join(tail)}")
    return out


def test_line_components_link_near_copies_inside_a_crowd(spark):
    for n_pairs in (20, 200):  # bands within CROWD, and beyond
        lines = crowd_of_pairs(random.Random(8), n_pairs)
        got = {(r["doc_id"], r["line_no"]): (r["kept_id"], r["kept_line"]) for r in line_dedup.line_components(docs_of(spark, lines), Scratch(spark)).collect()}
        want = brute_lines(lines)
        assert n_pairs <= len(set(want.values())) < 2 * n_pairs, "the crowd is not one component"
        assert sum(got[k] != want[k] for k in want) == 0, n_pairs


def test_line_components_of_lines_without_spaces(spark):
    draw = random.Random(21)
    lines = []
    for letters, mark in (([chr(0x4E00 + i) for i in range(800)], "〇"), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "="), ("0123456789\t", "x")):
        start = "".join(draw.choice(letters) for _ in range(16))
        for at in (4, 30, 100):  # a changed character inside and behind the common start
            for _ in range(20):
                x = start.strip() + "".join(draw.choice(letters) for _ in range(180)) + "."
                lines += [x, x[:at] + mark + x[at + 1 :]]
    assert lost_pairs(spark, lines) == []


def test_short_items_with_one_intact_seed_are_aligned():
    item = "alpha bravo charlie delta echo foxtrot"
    text = "before alpha bravo other delta echo foxtrot after"
    data, offsets = decontam.wh.text_buffers(pa.array([text], pa.string()))
    found = decontam.matches_of(decontam.Items([7], [item]), data, offsets)
    assert [(r, i, round(score, 4)) for r, i, score, *_ in found] == [(0, 7, 0.75)]


def test_chains_skip_any_number_of_anchors(spark):
    texts = ["the quick fox", "the quick of the a in to fox"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["s"] for r in spotsigs.signed(df, "text", "s").orderBy("doc_id").collect()]
    assert len(got[0]) == 1 and got[1] == got[0]


def test_of_repeated_rows_one_keeps_its_lines(spark):
    rows = [(1, "first line of it\n\nsecond line here"), (1, "first line of it\n\nsecond line here"), (None, "first line of it"), (2, None), (3, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = line_dedup.line_components(df, Scratch(spark)).collect()
    assert len(found) == 5 and sum(r["keep"] for r in found) == 2
    assert all(r["kept_id"] is None for r in found if r["line_no"] == 0)
    out = line_dedup.dedup_lines(df, Scratch(spark))
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == 5 and sum((t or "").count("first line of it") for t in texts) == 1
    assert sum((t or "").count("second line here") for t in texts) == 1 and None in texts and texts.count("") >= 1


def test_shingle_sets_and_their_sketches(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab é漢😀") for _ in range(300))
    lines = ["a", "😀😀", "12345", base, base[:140] + "x" + base[141:], base[30:] + base[:60], "abc" * 200]
    lines += ["".join(rng.choice("ab é漢😀") for _ in range(n)) for n in (6, 40, 300)]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    assert [r[0] for r in df.orderBy("key").select(F.size(line_dedup.shingle_set(F.col("line")))).collect()] == [len(s) for s in sets]
    sketches = line_dedup._sketches(df)
    assert {r["key"]: r["n"] for r in sketches.collect()} == {i: len(s) for i, s in enumerate(sets)}
    x, y = sketches.alias("x"), sketches.alias("y")
    kept = {(r[0], r[1]) for r in x.join(y, F.col("x.key") < F.col("y.key")).filter(line_dedup._room("x", "y")).select("x.key", "y.key").collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert (3, 4) in alike and alike <= kept and (3, 9) not in kept
    broken = spark.sql("SELECT cast(X'61FF62C328' AS string) AS line").select(F.size(line_dedup.shingle_set(F.col("line"))))
    assert broken.first()[0] == 1


@pytest.mark.parametrize("token, words_, edit", [(24, 28, "\t"), (24, 28, "-"), (44, 28, " "), (24, 28, ""), (40, 60, " "), (16, 30, "\t")])
def test_near_lines_with_unlike_numbers_of_words_are_found(spark, token, words_, edit):
    """Separators changed or gone: many word starts on one side, few on the other."""
    draw = random.Random(token + words_)
    texts = []
    for _ in range(12):
        own = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(token)) for _ in range(words_)]
        out = own[0]
        for i, w in enumerate(own[1:]):
            out += (edit if i % 7 < 3 or token > 30 else " ") + w
        texts += [" ".join(own), out]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    due = {i for i in range(0, 24, 2) if len(sets[i] & sets[i + 1]) >= 0.75 * len(sets[i] | sets[i + 1])}
    assert due
    rows = {r["doc_id"]: r for r in line_dedup.line_components(docs_of(spark, texts), Scratch(spark)).collect()}
    assert {i for i in due if rows[i]["kept_id"] == rows[i + 1]["kept_id"]} == due


def test_long_lines_of_few_shingles(spark):
    texts = ["ab" * 3000, "ab" * 3000 + "a", "abc" * 2000, "x" * 9000, "x" * 5]
    rows = {r["doc_id"]: r for r in line_dedup.line_components(docs_of(spark, texts), Scratch(spark)).collect()}
    kept = {i: r["kept_id"] for i, r in rows.items()}
    assert kept == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_frequent_shingles_make_no_line_candidates(spark):
    """lines that share only words which all lines have are in no band together; near copies are."""
    draw = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(draw.choice(letters) for _ in range(8))
    frequent = [word() for _ in range(24)]
    texts = []
    for _ in range(2000):
        own = [word() for _ in range(24)] + frequent
        draw.shuffle(own)
        texts.append(" ".join(own))
    texts += [t[:100] + "#" + t[101:] for t in texts[:20]]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("key", F.xxhash64("line"))
    scratch = Scratch(spark)
    stops = line_dedup.stop_shingles(lines)
    shared = line_dedup.shared_bands(line_dedup.signed(lines, stops), scratch)
    assert len(stops) >= len(frequent) and 40 <= shared.select("key").distinct().count() <= 60
    scratch.close()


def test_lines_alike_in_frequent_words_are_linked(spark):
    """near copies whose rare words all differ; what very many lines have counts like all else."""
    draw = random.Random(41)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    frequent, texts = [word() for _ in range(130)], []
    for _ in range(4):
        draw.shuffle(frequent)
        texts += [" ".join(frequent + [word() for _ in range(20)]) for _ in range(2)]
    for _ in range(700):
        own = frequent + [word() for _ in range(100)]
        draw.shuffle(own)
        texts.append(" ".join(own))
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts[:8]]
    assert all(len(sets[i] & sets[i + 1]) >= 0.75 * len(sets[i] | sets[i + 1]) for i in range(0, 8, 2))
    rows = {r["doc_id"]: r["kept_id"] for r in line_dedup.line_components(docs_of(spark, texts), Scratch(spark)).collect()}
    assert [rows[i] for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6] and all(rows[i] == i for i in range(8, 708))


def test_line_crowds_are_compared_by_their_rarest_shingles(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    lines = crowd_of_pairs(random.Random(8), 20)
    got = {(r["doc_id"], r["line_no"]): (r["kept_id"], r["kept_line"]) for r in line_dedup.line_components(docs_of(spark, lines), Scratch(spark)).collect()}
    assert got == brute_lines(lines)


def test_lines_that_repeat_themselves_meet_their_short_form(spark):
    """Equal sets of shingles, lines of 120 to 12,000 characters."""
    draw = random.Random(3)
    unit = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(58)) + "ab"
    texts = [unit * n for n in (2, 3, 40, 200)]
    assert {r["kept_id"] for r in line_dedup.line_components(docs_of(spark, texts), Scratch(spark)).collect()} == {0}
