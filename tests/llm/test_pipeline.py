import hashlib

import duckdb
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tapewright.llm.bpe import encode_decode
from tapewright.llm.mixing import mix, mix_sql
from tapewright.llm.parity_join import near_duplicates
from tapewright.llm.queries import tokenizer_path
from tapewright.llm.storage import written
from tapewright.llm.toxicity import fit

from .test_near import plain


def test_stages_on_messy_rows(spark, messy, small):
    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small)
        if name == "bpe":
            assert sorted((tuple(r) for r in docs.collect()), key=str) == sorted((tuple(r) for r in encode_decode(before, tokenizer_path()).collect()), key=str)
            continue
        assert docs.columns == before.columns
        rows = docs.collect()
        assert {r.n for r in rows} <= {"x"}
        if name == "ngram_jaccard_join":
            # one of each group; rows without text are groups of their own
            old = [(r.doc_id, r.text) for r in before.collect()]
            groups = {(c, n == 0 and (d, c)) for d, n, c in plain(old) if c is not None}
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
            assert len([r for r in rows if r.doc_id is not None]) == len(groups)
        if name == "mixing":
            taken = mix(before.select("doc_id", "text", "lang", "source"), corpus_pipeline.MIX, ["doc_id"])
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in taken.collect())


def test_stages_on_no_rows(spark, empty, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == []


def test_whole_tables_stage_by_stage(spark):
    """Each stage over all documents against a plain version: scores text by text, one of each component, the plan's SQL, the library's codes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    (_, toxic), (_, near), (_, mixed), (_, coded) = corpus_pipeline.STAGES
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = fit(docs, labels)
    scorer = model.scorer()
    clean = written(toxic(spark, docs, folder), "clean")
    got = {r.doc_id for r in clean.collect()}
    assert got == {d for d, t in texts.items() if model.score(scorer.evidence(t)[0]) < 0.5}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    told = [(marked[d], d in got) for d in texts if d in marked]
    assert sum(kept for bad, kept in told if not bad) >= 0.98 * sum(not bad for bad, _ in told)
    # this table has a few dozen toxic labels to learn from; accuracy on larger ones is test_toxicity's
    assert sum(not kept for bad, kept in told if bad) >= 0.6 * sum(bad for bad, _ in told)

    single = written(near(spark, clean, folder), "single")
    groups = near_duplicates(clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})

    taken = written(mixed(spark, single, folder), "taken")
    con = duckdb.connect()
    con.register("documents", single.toArrow())
    want = sorted(r[0] for r in con.execute(mix_sql(corpus_pipeline.MIX)).fetchall())
    assert sorted(r.doc_id for r in taken.collect()) == want and taken.columns == docs.columns

    library = Tokenizer.from_file(tokenizer_path())
    for r in coded(spark, taken, folder).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_whole_texts_go_to_python_in_small_batches(spark, small, monkeypatch):
    def sizes(docs, *_):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches), "n long")

    for name, stage in (("encode_decode", corpus_pipeline.bpe), ("accepted", corpus_pipeline.toxicity)):
        monkeypatch.setattr(corpus_pipeline, name, sizes)
        monkeypatch.setattr(corpus_pipeline, "fit", lambda *_: None)
        got = [r.n for r in stage(spark, spark.range(0, 5000, 1, 1), small).collect()]
        assert sum(got) == 5000 and max(got) <= corpus_pipeline.BATCH


def test_few_copies_shuffle_no_texts(spark, messy, small):
    """With few keys to leave out, the rows that stay aren't sorted or dealt out."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = corpus_pipeline.near_duplicate(spark, messy, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
