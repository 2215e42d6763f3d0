"""The corpus pipeline against its stages' brute force."""

import corpus_pipeline
import pandas as pd

from oracle import SF
from test_near_duplicates import kept_ids
from test_operators import hit_words, ids_of, spans_of
from tidemill.llm import quality


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = docs
    frames = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == columns, name
        frames.append(state.toPandas().sort_values("doc_id").reset_index(drop=True))
        state = spark.createDataFrame(frames[-1], docs.schema)
    scores = quality.score_quality(docs).where("keep").toPandas()
    assert sorted(frames[1].doc_id) == sorted(scores.doc_id)
    assert frames[2].doc_id.tolist() == kept_ids(frames[1][["doc_id", "text"]].values.tolist())  # five words, 0.8
    items = pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    assert frames[3].doc_id.tolist() == [d for d, t in zip(frames[2].doc_id, frames[2].text) if not hit_words(t, items)[1]]
    assert frames[4].doc_id.tolist() == frames[3].doc_id.tolist()
    assert not any(spans_of(t) for t in frames[4].text)
    clean = [not spans_of(t) for t in frames[3].text]
    assert frames[4].text[clean].tolist() == frames[3].text[clean].tolist()
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    want = {d: len(ids_of(t, 1)) for d, t in zip(frames[4].doc_id, frames[4].text)}
    assert pieces.groupby("doc_id").length.sum().to_dict() == want


def test_odd_and_empty_tables(spark, odd, none):
    pieces = corpus_pipeline.run(spark, odd).toPandas()
    assert pieces.doc_tokens.notna().all() and (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert corpus_pipeline.run(spark, none).count() == 0
