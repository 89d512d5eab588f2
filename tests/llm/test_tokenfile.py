import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from weftline.llm import queries, tokenfile, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.sets(st.integers(-(2**63) + 1, 2**63 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.int64)
    mph = tokenfile.PerfectHash.build(k)
    assert sorted(mph.slots(k).tolist()) == list(range(len(k)))


def test_leftover_keys_are_found(monkeypatch):
    monkeypatch.setattr(tokenfile, "LEVELS", 1)
    k = np.arange(-500, 500)
    mph = tokenfile.PerfectHash.build(k)
    assert len(mph.rest) and sorted(mph.slots(k).tolist()) == list(range(1000))


def test_round_trip_equals_brute_force(spark):
    tok = Tokenizer.from_file(PATH)
    at, want = 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op10_token_ids"](spark, SF).collect()) == want


def test_keyed_access_and_odd_rows(spark, tmp_path):
    rows = [(7, "seven", "x"), (None, "none", "x"), (3, None, "x"), (7, "again seven", "x"), (-5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = f"file://{tmp_path}/ids"
    manifest = tokenfile.write_shards(docs, PATH, out, shards=1).collect()
    assert [(m.n_docs, m.shard) for m in manifest if m.n_docs] == [(5, 0)]
    shard = tokenfile.Shards(out, manifest)
    tok = Tokenizer.from_file(PATH)
    ids = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 0]
    assert sorted(d.tolist() for d in shard.documents(7)) == sorted([ids("seven"), ids("again seven")])
    assert [d.tolist() for d in shard.documents(None)] == [ids("none")]
    assert [d.tolist() for d in shard.documents(3)] == [[0]]
    assert shard.documents(8) == [] and shard.documents(-100) == [] and shard.documents(10**12) == []
    back = tokenfile.round_trip(docs, PATH, 3).collect()
    assert sorted((r.start, r.n_tokens) for r in back)[0][0] == 0
    assert sorted((str(r.doc_id) for r in back)) == sorted(str(r[0]) for r in rows)
    order = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert order == [None, -5, 3, 7, 7]
    assert tokenfile.round_trip(docs.limit(0), PATH).count() == 0


def test_lookups_over_a_set_of_shards(spark, tmp_path, monkeypatch):
    """Every key through the manifest, in a bounded number of small reads; foreign keys give nothing."""
    docs = spark.range(600).selectExpr("id * 3 - 300 AS doc_id", "concat('text ', id) AS text")
    out = f"file://{tmp_path}/ids"
    manifest = tokenfile.write_shards(docs, PATH, out, shards=5).collect()
    shards, tok = tokenfile.Shards(out, manifest), Tokenizer.from_file(PATH)
    for r in docs.collect():
        assert [d.tolist() for d in shards.documents(r.doc_id)] == [[*tok.encode(r.text, add_special_tokens=False).ids, 0]]
        assert shards.documents(r.doc_id + 1) == []
    assert len(shards.open) == len([m for m in manifest if m.n_docs]) > 1
    assert sum(p.reads for p in shards.open.values()) < 12 * 1200
    monkeypatch.setattr(tokenfile, "RANGE", 20)
    fs, root = tokenfile.file_system(out)
    m = next(m for m in manifest if m.n_docs)
    whole = tokenfile.Shard(fs, f"{root}/ids-{m.shard:05d}")
    with fs.open_input_file(f"{whole.stem}.bin") as f:
        got = [x.tolist() for x in whole.read(f, np.arange(whole.n))]
    assert got == [shards.documents(int(k))[0].tolist() for k in whole.keys]


def test_leftover_keys_are_read_by_place(monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "LEVELS", 1)
    keys, offsets = np.arange(-50, 50) * 7, np.arange(101)
    (tmp_path / "ids-00000.idx").write_bytes(tokenfile.index_bytes(keys, offsets, 2))
    (tmp_path / "ids-00000.bin").write_bytes(np.arange(100, dtype="<u2").tobytes())
    fs, root = tokenfile.file_system(f"file://{tmp_path}")
    places = tokenfile._Places(fs, f"{root}/ids-00000")
    assert places.n_rest and [places.documents(int(k))[0].tolist() for k in keys] == [[i] for i in range(100)]
    assert places.documents(3) == []


_TEXT = st.lists(st.sampled_from([*"abZé.,!*#7 '_-", "\n", "\n\n", "\t", "\r", "\xa0", "\x00", "\x1c", "\u2028", "ﬁ", "漢", "😀", " the", " the.", "\nthe,", "<|endoftext|>", "<|"]), max_size=40).map("".join)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_in_bulk_have_the_library_s_ids(name):
    enc, tok = tokens.Encoder(public_tokenizers.path(name), 30), Tokenizer.from_file(public_tokenizers.path(name))

    @given(st.lists(st.none() | _TEXT, max_size=12), st.sampled_from([1, 20, 10**6]), st.sampled_from([1, 7, 10**4]))
    @settings(max_examples=200, deadline=None)
    def run(texts, bulk, some):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokens, "BULK", bulk)
            m.setattr(tokens, "SOME", some)
            got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.many(iter(texts))]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]

    run()


def test_a_word_is_encoded_once_for_a_batch_of_texts(monkeypatch, tmp_path):
    """More words than the cache holds come again in every text, with and without marks."""
    words = [f"{a}{b}ra" for a in "bcdfghklmn" for b in "aeiouyäöüé"]
    texts = [" ".join(w + "." * (k % 2) for w in words) for k in range(30)]
    seen, word = [], tokens.Encoder.word
    monkeypatch.setattr(tokens.Encoder, "word", lambda self, w: seen.append(w) or word(self, w))
    monkeypatch.setattr(tokenfile, "encoder", lambda path, *_: tokens.Encoder(path, 20))
    monkeypatch.setattr(tokenfile, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = list(tokenfile._write(PATH, f"file://{tmp_path}")(iter([batch])))
    tok = Tokenizer.from_file(PATH)
    want = [i for t in texts for i in [*tok.encode(t, add_special_tokens=False).ids, 0]]
    assert np.fromfile(tmp_path / "ids-00000.bin", "<u2").tolist() == want and rows[0].column(2).to_pylist() == [len(want)]
    assert len(seen) <= len(words) + 10
