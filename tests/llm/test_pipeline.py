import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_print
from weftline.llm import decontam, linededup, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_model(docs, labels)
    rows = sorted(tuple(r) for r in docs.select(COLUMNS).collect())
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        assert out.columns == COLUMNS
        return sorted(tuple(r) for r in out.collect())

    want = [r for r in rows if model.score(r[1]) < 0.5]
    got = stage("toxicity", rows)
    assert got == want and len(got) < len(rows)

    first = brute_lines([(r[0], r[1]) for r in got])
    want = []
    for d, t, lang, source, n in got:
        kept = [x for i, x in enumerate(t.split("\n")) if first.get((d, i), (d, i)) == (d, i)]
        if any(x.strip(linededup.STRIP) for x in kept) or not any(i == d for i, _ in first):
            want.append((d, "\n".join(kept), lang, source, len("\n".join(kept))))
    rows, got = got, stage("line_dedup", got)
    assert got == want and len(got) < len(rows)

    own = [*got, (1000, got[3][1], "en", "x", 1), (1001, got[5][1].upper(), "en", "x", 1)]  # line dedup leaves few copies
    comps = brute_components([brute_print(r[1]) for r in own])
    least = {}
    for r, c in zip(own, comps, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    want = [r for r, c in zip(own, comps, strict=True) if least[c] == r[0]]
    kept = stage("simhash_near_dedup", own)
    assert kept == sorted(want) and len(kept) < len(own)

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in kept])
    c.execute(f"CREATE VIEW benchmark AS FROM '{SF}/benchmark.parquet'")
    bad = {r[0] for r in c.execute(decontam.SQL).fetchall()}
    clean = stage("benchmark_decontamination", kept)
    assert bad and clean == [r for r in kept if r[0] not in bad]

    packed = stages["best_fit_packing"](spark, spark.createDataFrame(clean, docs.schema), SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in clean}
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in n} == n
    seqs = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        ends = np.cumsum([x for _, x in sorted(s)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(s)] == [0, *ends[:-1].tolist()]


def test_odd_rows_and_older_results(spark):
    """Null and empty texts, null and repeated ids; an empty table; and a result made before is still there after."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in docs.orderBy("doc_id").select(COLUMNS).limit(6).collect()]
    rows = [*some, (some[0][0], "another text with the id of the first one", "en", "x", 1), some[1], (None, "words of no one with an id", None, None, None), (7001, None, None, None, None), (7002, "", "en", None, 0)]
    older = simhash.simhash_components(docs)
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for start in (rows, []):
        out = spark.createDataFrame(start, docs.schema)
        for name, stage in corpus_pipeline.STAGES:
            got = [tuple(r) for r in stage(spark, out, SF).collect()]
            if name != "best_fit_packing":
                out = spark.createDataFrame(got, docs.schema)
        texts = {r.text for r in out.collect()}
        if start:
            assert {"another text with the id of the first one", "words of no one with an id"} <= texts and len(got) >= len(texts)
            assert sum(r.text in (None, "") for r in out.collect()) == 1  # linked like any other
        else:
            assert not texts and not got
    assert older.count() == docs.count()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    corpus_pipeline.run(spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batch and older.count() == docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
