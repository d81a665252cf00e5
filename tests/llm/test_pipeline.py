import corpus_pipeline
from vecharbor.llm import bpe, decontam, quality, queries, simhash, toxicity


def test_stages_keep_what_their_operators_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir).cache()
        assert out.columns == docs.columns, name
        if name == "quality classifier":
            want = ids(quality.scored(now, quality.fit(now, labels)).where("score >= 0.7"))
        elif name == "toxicity":
            want = ids(toxicity.scored(now, toxicity.fit(now, labels)).where("score < 0.7"))
        elif name == "SimHash near-dedup":
            want = ids(simhash.near_duplicates(now).where("doc_id = component_id"))
        else:
            want = ids(decontam.contamination(now, items).where("NOT contaminated"))
        assert ids(out) == want and out.count() == len(want), name
        now = out
    last = {tuple(r) for r in bpe.encoded(now, queries.vocabulary()).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == last


def test_stages_bear_odd_rows(spark, sf_dir, odd, none):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf_dir).columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() == frame.count()
