"""The five stages on small tables."""

import hashlib
from collections import Counter

import numpy as np

from cairnspark.llm import jaccard_product, langmask, pieces, poisson_mix, quality_gbt
from cairnspark.llm._common import materialise
from tests.llm.test_text_operators import _brute, _quantile, kept_one_by_one


def test_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == before.columns
        assert docs.select("doc_id").exceptAll(docs.select("doc_id").intersectAll(docs.select("doc_id"))).count() == 0
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert sizes[1] > 0.6 * sizes[0] and sizes[2] > 0.98 * sizes[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == sizes[-1] and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]


def test_run_matches_brute_force(spark, sf_dir):
    """The rows of run(), each stage done one by one; the two models are those that the stages train."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    trees = quality_gbt.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if kept_one_by_one(r.text, trees)]
    model = langmask.train(spark.createDataFrame(rows, docs.schema))
    names, _, known = model.predict([r.text for r in rows])
    rows = [r for r, name, k in zip(rows, names, known, strict=True) if name != "und" and k >= corpus_pipeline.MIN_KNOWN]
    rows = [r for r, (i, _, component, _) in zip(rows, _brute(rows), strict=True) if i == component]
    sizes = Counter(r.source for r in rows)
    weight = {s: n**poisson_mix.TEMPERATURE for s, n in sizes.items()}
    tok, want = pieces.tokenizer(pieces.default_path()), []
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * len(rows) / sizes[r.source]
        u = int(hashlib.md5(f"{poisson_mix.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = tok.encode(r.text, add_special_tokens=False).ids
        row = (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * _quantile(u, rate)
    assert len(want) > 50 and sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_no_links_are_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = materialise(jaccard_product.keep_first(docs), "test-kept")
    again = jaccard_product.jaccard_classes(kept)
    assert again.where("n_links > 0").count() == 0


def test_mixing_carries_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["u", "times", "cdf", "rate_source", "n", "weight", "named", "rate", "copy", "shuffle_key", "docs_1", "a.b"]
    docs = spark.createDataFrame([(i, "t", f"s{i % 2}", *(f"{c}{i}" for c in names)) for i in range(40)], ["doc_id", "text", "source", *names])
    before = {r[0]: tuple(r) for r in docs.collect()}
    out = corpus_pipeline.mixing(spark, docs, "")
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and rows and all(before[r[0]] == r for r in rows)
    mixed = poisson_mix.mix(docs)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in rows) and all(before[r.doc_id][3] == r.u for r in mixed.collect())


def test_odd_rows_pass_through(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = materialise(stage(spark, docs, sf_dir), f"odd-{name}")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
