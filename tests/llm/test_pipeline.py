import os

import pytest

from gridloom.llm import bpe, decontam, langid, toxicity

from .test_joins import brute_jaccard, brute_leaks

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "decontamination", "bpe"]
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    clean &= {r.doc_id for r in langid.identify(left, langid.sample(left)).where("lang_pred <> 'und'").collect()}
    texts = [(i, rows[i].text) for i in sorted(clean)]
    texts = [(i, t) for (i, t), (c, _) in zip(texts, brute_jaccard(texts)) if c == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    index = decontam.Index(items)
    # the lemma's promise is held against full alignment elsewhere; here short documents are
    leaks = {x for x, _, _ in brute_leaks([(i, t) for i, t in texts if len(t) < 1500], items)}
    import pyarrow as pa

    from gridloom.llm import text

    found = set()
    for a, _, data, offsets in text.chunks(pa.array([t for _, t in texts])):
        found |= {texts[a + x[0]][0] for x in index.find(data, offsets)}
    assert {i for i in found if len(rows[i].text) < 1500} == leaks
    b = bpe.load(bpe.vocabulary_path())
    want = {i: b.encode(t) for i, t in texts if i not in found}
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: x[0] for i, x in got.items()} == want
    assert all(x[1] == len(x[0]) and x[2] == rows[i].text for i, x in got.items())


def test_stages_keep_columns(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
