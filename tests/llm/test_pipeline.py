"""The pipeline's result against a plain version of its stages."""

import corpus_pipeline
from tessellex.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_the_plain_version_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [r for r in rows if toxicity.document_score(toxicity.score_sentences(r["text"], model), model) < corpus_pipeline.TOXIC_FROM]
    last = {}
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        last[r["text"]] = r
    sets = {}
    for r in last.values():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    kept = spark.createDataFrame([r for r in last.values() if part[r["doc_id"]] == r["doc_id"]], docs.schema)
    expected = sorted(r["doc_id"] for r in mixing.mix(kept).collect())
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == expected
    assert all(r["decoded_equal"] for r in out)
