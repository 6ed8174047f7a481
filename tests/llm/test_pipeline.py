import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from rangescan.llm.decontamination import _cleaned, automata, words_of
from rangescan.llm.queries import ORACLES, QUERIES
from rangescan.llm.toxicity import fit
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import similar


def test_run_equals_the_stages_by_brute_force(spark, docs, sf_dir):
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.d, r.text or "") for r in docs.withColumn("d", F.xxhash64("text")).collect()]
    rows = [r for r in rows if model.probability(words_of(r[2].encode())) < 0.7]
    lines = plain_lines(rows, 10)
    rows = [(d, lines[d, t][2]) for d, _, t in rows if lines[d, t][1] < lines[d, t][0]]
    kept = set(similar(rows))
    blocks = automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = [(d, _cleaned(blocks, t.encode(), 0.5)) for d, t in rows if d in kept]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: len(library.encode(t.decode(), add_bos=True, add_eos=True)) for d, t in rows if t is not None}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()} == want
    assert len(want) < docs.count()


def test_stages_keep_the_columns_and_bear_odd_rows(spark, odd, none, sf_dir, tmp_path):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
            df = out if name != corpus_pipeline.STAGES[-1][0] else df
        assert out.count() >= 0


def test_registered_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)] and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
