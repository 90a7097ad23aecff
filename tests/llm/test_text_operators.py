"""Language ID, mixing, quality rules and the Jaccard join."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import components, jaccard_product, langmask, poisson_mix, quality_gbt
from cairnspark.llm._common import text_slices
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")


# --- language ID --------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = langmask.identify(langmask.with_fold(docs), langmask.train(docs), carry=["held_out", "lang"]).where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_a_language_or_und(odd_docs, no_docs):
    model = langmask.train(odd_docs)
    got = {r.doc_id: r for r in langmask.identify(odd_docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 11))
    assert got[1].lang_pred in model.languages
    assert langmask.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in langmask.identify(odd_docs, langmask.train(no_docs)).collect()} == {"und"}


def _grams(text: str) -> list[str]:
    """Letter n-grams of 3 and 4 that may begin or end with a blank, one by one; letter-less characters are blanks."""
    s = "".join(c if c.isalpha() and ord(c) < 0x30000 else " " for c in f" {text.lower()} ")
    found = (s[i : i + n] for n in langmask.GRAMS for i in range(len(s) - n + 1))
    return [g for g in found if " " not in g[1:-1] and not g[0] == g[-1] == " "]


def test_predictions_are_those_of_sets(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    model = langmask.train(docs)  # the sample is larger than the table, so it holds all rows
    rows, seen, of = docs.collect(), Counter(), {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen[r.lang] += 1
            of.setdefault(r.lang, Counter()).update(set(_grams(r.text)))
    share = {x: {g: n / seen[x] for g, n in c.items() if n >= max(2.0, langmask.MIN_SHARE * seen[x])} for x, c in of.items()}
    top = Counter()
    for c in share.values():
        for g, s in c.items():
            top[g] = max(top[g], s)
    sets = {x: {g for g, s in c.items() if s * langmask.CONTRAST >= top[g]} for x, c in share.items()}
    assert model.languages == sorted(sets)
    # every n-gram is in its languages' filters, and what is in them besides is as rare as the filters promise
    for k, x in enumerate(model.languages):
        for g in sorted(sets[x])[::50]:
            codes = np.array([0x20 if c == " " else ord(c) for c in g], np.uint32)
            assert int(model.masks(langmask.gram_hashes(codes, (len(g),))[0])[0]) >> k & 1
    got = {r.doc_id: r for r in langmask.identify(docs, model).collect()}
    for r in rows:
        grams = _grams(r.text or "")
        hits = {x: sum(g in s for g in grams) for x, s in sets.items()}
        order = sorted(hits, key=lambda x: (-hits[x], x))
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und"
        elif hits[order[0]] - hits[order[1]] > 5 * max(1.0, (len(grams) * float(model.chance.max())) ** 0.5):  # beyond chance hits
            assert got[r.doc_id].lang_pred == order[0], (r, hits)
            assert abs(got[r.doc_id].known - hits[order[0]] / max(1, len(grams))) < 0.03


def test_masks_return_every_language_of_an_ngram():
    r = np.random.default_rng(1)
    names = [f"l{i:02d}" for i in range(70)]
    grams = [r.integers(0, 1 << 63, 200).astype(np.uint64) for _ in names]
    grams[3][:50] = grams[66][:50]
    f = langmask.MaskFilter(names, grams)
    for n, g in enumerate(grams):
        assert ((f.masks(g, n // 64) >> np.uint64(n % 64)) & np.uint64(1)).all()
    assert ((f.masks(grams[3][:50], 1) >> np.uint64(2)) & np.uint64(1)).all()
    # chance hits are taken off: unknown n-grams score about nothing
    noise = r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.hits(noise, np.array([0, len(noise)])).max() < 200


# --- mixing -------------------------------------------------------------------------------------------------------


def _quantile(u: float, rate: float) -> int:
    p = c = math.exp(-rate)
    k = 0
    while u >= c and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_are_poisson_quantiles(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "cold").alias("source"), F.lit("x").alias("copy"))
    weights = spark.createDataFrame([("hot", 1.0), ("cold", 5.0), (None, 2.0), ("gone", 4.0)], "source string, weight double")
    out = poisson_mix.mix(docs, weights, rows=6000)
    rate = {"hot": 1 / 8 * 6, "cold": 5 / 8 * 6, None: 2 / 8 * 6}
    n = Counter(r.doc_id for r in out.collect())
    u = {r.doc_id: r.u for r in docs.select("doc_id", poisson_mix.uniform(poisson_mix.SEED, F.col("doc_id").cast("string")).alias("u")).collect()}
    for i in range(3000):
        assert n[i] == _quantile(u[i], rate[("hot", "cold", None)[i % 3]]), i
    assert abs(sum(n.values()) - 6000) < 400
    keys = [r.shuffle_key for r in out.collect()]
    assert len(set(keys)) == len(keys)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key", "rate"]


def test_mixing_odd_tables(odd_docs, no_docs, spark):
    out = poisson_mix.mix(odd_docs)
    assert set(odd_docs.columns) | {"shuffle_key", "rate"} == set(out.columns) and dict(out.dtypes)["copy"] == "int"
    assert out.count() > 0 and poisson_mix.mix(no_docs).count() == 0
    none = spark.createDataFrame([("a", 0.0), ("b", None)], "source string, weight double")
    assert poisson_mix.mix(odd_docs, none).count() == 0
    high = {r.rate: r["count"] for r in poisson_mix.mix(odd_docs, rows=60_000).groupBy("rate").count().collect()}
    assert max(high) > 700 and abs(sum(high.values()) - 60_000) < 1500


def test_high_rates_are_sums_of_quantiles(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "small").otherwise("large").alias("source"))
    weights = spark.createDataFrame([("small", 3.0), ("large", 1.0)], "source string, weight double")
    n = Counter(r.doc_id for r in poisson_mix.mix(docs, weights, rows=2000).collect())
    for i in range(30):
        rate = 500.0 if i < 3 else 500 / 27
        draws = max(1, math.ceil(rate / poisson_mix.MAX_STEP))
        names = [f"{poisson_mix.SEED}:{i}" if k == 1 else f"{poisson_mix.SEED}:draw:{i}:{k}" for k in range(1, draws + 1)]
        us = [int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / (1 << 52) for x in names]
        assert n[i] == sum(_quantile(u, rate / draws) for u in us), i


# --- quality rules ------------------------------------------------------------------------------------------------


def _counts(text: str | None) -> tuple:
    t = text or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_counts_match_brute_force(odd_docs, no_docs):
    r = random.Random(2)
    texts = ["".join(r.choice("ab \n\t#é|\x0b\xa0") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a b c a b c", "x\nx\n\nx", "\n", "a a a a"]
    import pyarrow as pa

    got = []
    for _, _, data, offsets in text_slices(pa.record_batch({"text": texts}), "text", 500):
        s = quality_gbt.statistics(data, offsets)
        got += list(zip(*(s[c].tolist() for c in quality_gbt.COUNTS), strict=True))
    assert got == [_counts(t) for t in texts]
    rows = quality_gbt.judge(odd_docs, None, carry=odd_docs.columns).collect()
    assert sorted(map(repr, (tuple(r[c] for c in quality_gbt.COUNTS) for r in rows))) == sorted(map(repr, (_counts(r.text) for r in odd_docs.collect())))
    assert all(r.kept != r.base_failed for r in rows)
    assert quality_gbt.judge(no_docs, None).count() == 0


def _features(text: str | None) -> list[float]:
    """The features of a text in the order of FEATURES, from the text itself."""
    t = text or ""
    raw, w = t.encode(), WORD.findall(t)
    n_words, chars, symbols, dup, repeat = _counts(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    words, any_chars = max(1, n_words), max(1, chars)
    count = lambda of: sum(b in of for b in raw)
    upper, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    letters = count(upper + upper.lower() + bytes(range(0xC0, 0x100)))
    punct, space = b".,;:'\"()-", b" \t\n\x0b\x0c\r"
    return [
        math.log1p(n_words), chars / words, symbols / any_chars, dup / max(1, len(lines)), repeat / words, count(upper) / max(1, letters), count(digits) / any_chars, count(b"!?") / words,
        len(set(w)) / words if w else 1.0, count(b"|") / words, count(punct) / words, n_words / max(1, len(lines)), 1 - (letters + count(digits + punct + space)) / max(1, len(raw)),
    ]


def kept_one_by_one(text: str | None, trees) -> bool:
    c = _counts(text)
    failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
    return not failed and (trees is None or 1 / (1 + math.exp(-_walk(trees, _features(text)))) >= quality_gbt.KEEP_AT)


def test_verdicts_match_brute_force(spark, sf_dir, odd_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_gbt.train(spark, docs, labels)
    for table in (docs.select("doc_id", "text"), odd_docs.where("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text")):
        got = sorted((str(r.text), r.kept) for r in quality_gbt.judge(table, trees, carry=["text"]).collect())
        assert got == sorted((str(r.text), kept_one_by_one(r.text, trees)) for r in table.collect())


def _walk(trees, row) -> float:
    out = trees.bias
    for at in trees.roots:
        while trees.feature[at] >= 0:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        out += trees.value[at]
    return out


def test_a_small_sample_of_both_classes_gives_a_model(spark):
    docs = spark.createDataFrame([(i, prose(i, 80)) for i in range(4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 0)], "doc_id bigint, quality int")
    trees = quality_gbt.train(spark, docs, labels)
    rows = quality_gbt.judge(docs, trees).collect()
    assert all(abs(r.quality_score - 0.25) < 1e-6 and not r.kept and not r.base_failed for r in rows) and len(rows) == 4
    assert quality_gbt.train(spark, docs, labels.where("quality = 0")) is None


def test_trees_are_monotonic_and_flat_scoring_is_the_walk():
    r = np.random.default_rng(4)
    x = r.random((800, 3))
    y = ((x[:, 0] - 0.6 * x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + 0.2 * r.standard_normal(800)) > 0.2).astype(float)
    t = quality_gbt.grow(x, y, [1, -1, 0], trees=30)
    assert np.allclose(t.margin(x[:50]), [_walk(t, row) for row in x[:50]])
    grid = np.linspace(0, 1, 60)
    for row in x[:60]:
        for j, sign in ((0, 1), (1, -1)):
            many = np.tile(row, (60, 1))
            many[:, j] = grid
            assert (sign * np.diff(t.margin(many)) >= -1e-12).all()
    assert ((t.chance(x) > 0.5) == (y > 0.5)).mean() > 0.85


def test_quality_model_on_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_gbt.train(spark, docs, labels)
    rows = quality_gbt.judge(docs, trees).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / max(1, len(bad)) < 0.2
    assert quality_gbt.train(spark, docs, labels.limit(0)) is None
    assert quality_gbt.train(spark, docs, labels.where("quality = 1")) is None


# --- Jaccard join -------------------------------------------------------------------------------------------------


def _sets(rows) -> list:
    out = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _brute(rows) -> list[tuple]:
    sets, parent = _sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low: dict = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, len(sets[i]), low.get(find(i)), links[i]) for i, r in enumerate(rows)]


def _check(docs, **more):
    got = [tuple(r) for r in jaccard_product.jaccard_classes(docs, **more).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _brute(docs.select("doc_id", "text").collect())))


def test_classes_of_odd_rows(odd_docs, no_docs):
    _check(odd_docs)
    assert jaccard_product.jaccard_classes(no_docs).count() == 0
    assert jaccard_product.keep_first(no_docs).count() == 0
    kept = jaccard_product.keep_first(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    # the null row with the text of document 1 goes with it; the one without a text is linked to nothing
    assert kept.columns == odd_docs.columns and 1 in ids and not {2, 3} & set(ids) and ids.count(None) == 1


def test_rows_of_one_doc_id_go_with_their_own_components(spark):
    a, b, c = (prose(k, 80) for k in (501, 502, 503))
    rows = [(5, a), (5, b), (5, b.upper()), (2, c), (7, c), (7, prose(504, 80)), (9, a), (8, ""), (8, ""), (6, prose(505, 80))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, shingle_node int")
    kept = jaccard_product.keep_first(docs)
    got = sorted((r.doc_id, r.text.lower()) for r in kept.collect())
    assert kept.columns == docs.columns
    # (7, c) is a copy of 2 and goes; the other row of 7 is linked to nothing, and its own component's first
    assert got == sorted((i, t.lower()) for i, t in [(5, a), (5, b), (2, c), (7, rows[5][1]), (8, ""), (8, ""), (6, rows[9][1])])


def _family(seed: int, n: int, words: int, edits: int) -> list[str]:
    r = random.Random(seed)
    base = [f"{w}{r.randint(0, 30)}" for w in prose(seed, words).split()]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("way", ["whole", "cut", "hot", "shared names"])
def test_classes_match_brute_force(spark, monkeypatch, way):
    more = {"hot": {"hot": 8, "block_entries": 500}, "shared names": {"mask": 7}}.get(way, {})
    if way == "cut":
        for name in ("BLOCK_NODES", "SMALL_NODES"):
            monkeypatch.setattr(jaccard_product, name, 16)
    texts = _family(1, 60, 80, 5) + _family(2, 25, 40, 3) + _family(3, 3, 300, 12) + _family(4, 20, 7, 1) + [prose(900 + i, 60) for i in range(20)]
    passage = prose(77, 55)
    texts += [f"{prose(1000 + i, 15)} {passage} {prose(2000 + i, 10)}" for i in range(25)] + ["one two three", "ONE two  three", "one two three four", "a b c d e", "a b c d e f"]
    order = random.Random(9).sample(range(len(texts)), len(texts))
    _check(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id bigint, text string"), **more)


def thue_morse(n: int, one: str = "a", two: str = "b") -> str:
    return "".join((one, two)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_that_polynomial_hashes_confuse(spark, n):
    pair = [thue_morse(n), thue_morse(n, "b", "a")]
    assert _counts("\n".join(pair))[3] == 0
    _check(spark.createDataFrame([(i, f"{t} one {t}" if k else t) for k in (0, 1) for i, t in enumerate(pair, 2 * k)], "doc_id bigint, text string"))
    rows = spark.createDataFrame([(0, "\n".join(pair)), (1, " ".join([pair[0], "x", "y", pair[1], "x", "y"])), (2, " ".join(pair * 2))], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in quality_gbt.COUNTS) for r in quality_gbt.judge(rows, None).collect()}
    assert got == {r.doc_id: _counts(r.text) for r in rows.collect()}


def test_null_ids_and_copies_go_with_their_components(spark):
    a, b, c = (prose(k, 80) for k in (601, 602, 603))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, prose(604, 80)), (None, a), (None, prose(605, 80)), (None, prose(605, 80)), (None, None), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(repr, map(tuple, jaccard_product.keep_first(docs).collect())))
    assert got == sorted(map(repr, [(3, a), (5, b), (7, c), rows[4], rows[6], (None, None)]))


def test_sparse_and_dense_products_agree():
    r = np.random.default_rng(3)
    sets = [np.stack([np.sort(r.choice(60, r.integers(1, 40), replace=False)).astype(np.uint64)] * 2) for _ in range(30)]
    sets += [np.stack([s[0], s[1] + np.uint64(1)]) for s in sets[:3]]  # equal first lanes, other columns
    both = np.array([[len({*map(tuple, x.T.tolist())} & {*map(tuple, y.T.tolist())}) for y in sets] for x in sets])
    off = ~np.eye(len(sets), dtype=bool)  # columns of one set aren't counted, not even with itself
    assert np.array_equal(jaccard_product.dense_overlaps(sets)[off], both[off])
    assert np.array_equal(jaccard_product.dense_overlaps(sets[:9], sets[9:]), both[:9, 9:])
    n = np.array([s.shape[1] for s in sets])
    who = np.repeat(np.arange(len(sets)), n)
    order, column = jaccard_product._columns(who, np.concatenate(sets, axis=1), np.zeros(len(who), int))
    i, j = jaccard_product.sparse_links(n, who[order], column)
    want = {(x, y) for x in range(len(sets)) for y in range(x) if 100 * both[x, y] >= 75 * (n[x] + n[y] - both[x, y])}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (-5, 300), (300, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50)) and {got[-5], got[300], got[200]} == {-5}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
