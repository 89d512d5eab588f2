import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from weftline.llm import packing, queries
from weftline.llm.tokens import Encoder, _Words

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    """Gapless from 0, never over capacity; returns the number of sequences."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs)


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150)
def test_best_fit(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets, fills = packing.best_fit(n, 40)
    assert (fills <= 40).all() and fills.sum() == n.sum()
    for b in range(len(fills)):
        own = sorted(zip(offsets[bins == b].tolist(), n[bins == b].tolist(), strict=True))
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]
    assert len(fills) >= -(-int(n.sum()) // 40)


def test_tree_of_rounds(spark):
    """13 groups of some 230 items stay within 3 % of what best fit makes of all at once."""
    rng = random.Random(4)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 21, 34, 55, 60, 99]) for _ in range(3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long")
    rows = packing.pack(items, 100, fan_in=3, group=230).collect()
    assert sorted((r.item, r.length) for r in rows) == sorted(enumerate(lengths))
    assert check(rows, 100) <= 1.03 * len(packing.best_fit(np.array(lengths), 100)[2])


def test_merging_saves_sequences(spark):
    items = spark.createDataFrame([(i, 10) for i in range(50)], "item long, length long")
    assert check(packing.pack(items, 100, fan_in=3, group=6).collect(), 100) <= 6
    # one group of many open bins keeps no other from merging, and bins that fit nowhere end the rounds
    mixed = spark.createDataFrame([(i, 60) for i in range(40)] + [(i, 10) for i in range(40, 80)], "item long, length long")
    assert check(packing.pack(mixed, 100, group=8).collect(), 100) <= 41
    assert check(packing.pack(mixed.where("length = 60"), 100, group=8).collect(), 100) == 40


def test_items_grouped_by_length(spark):
    """Files of long items and files of short ones meet: 300 sequences at best, 450 if each file packed its own."""
    items = spark.createDataFrame([(i, 55 if i < 300 else 45) for i in range(600)], "item long, length long").repartitionByRange(6, "item")
    assert check(packing.pack(items, 100, group=100).collect(), 100) <= 330


def test_any_column_names(spark):
    items = spark.createDataFrame([(i, 10, 1, 2, "x", 5) for i in range(9)], "bin long, length long, fill int, n int, c1 string, offset int")
    out = packing.pack(items, 100)
    assert out.columns == ["bin", "length", "fill", "n", "c1", "sequence_id", "offset"]
    assert check(out.collect(), 100) == 1 and sorted(r.bin for r in out.collect()) == list(range(9))


def test_documents(spark):
    want = {}
    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want[r.doc_id, k] = (at, len(own), zlib.crc32(own.tobytes()))
    rows = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(r.length for r in rows)
    assert check(rows, 2048) <= -(-total // 2048) + 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (1, "word " * 5000, "x"), (1, "word " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(df, PATH).collect()
    assert sorted(r.length for r in out if r.doc_id == 2) == [1]
    assert sorted((r.piece, r.length) for r in out if r.doc_id == 1) == [(0, 1), (0, 2048), (0, 2048), (1, 2048), (1, 2048), (2, 905), (2, 905)]
    check(out, 2048)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


PIECES = ["word", "Ünïcode", "naïve", " ", "  ", "\n", "\t", "don't", "3.14", "x\x1cy", "\x00", "<|endoftext|>", "日本", "…!", "\u0301", "İ", "ß", ".", "a.", "ab,", "a##", "\x00#", "<|startoftext|>", "<|", "\xa0", "'s"]


@given(st.lists(st.sampled_from(PIECES), max_size=14))
@settings(max_examples=300, deadline=None)
def test_cached_tokens_are_the_librarys(parts):
    text = "".join(parts)
    for enc, lib in ENCODERS:
        assert enc.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_librarys():
    for text in ("hello <|endoftext|> world", "<|startoftext|>a", "a<|ENDOFTEXT|>", "<|endoftext|>", "<| endoftext|>", "x <|endoftext|><|endoftext|>\n"):
        for enc, lib in ENCODERS:
            assert enc.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_generations_of_cached_words():
    enc = Encoder(PATH, words=3)
    lib = Tokenizer.from_file(PATH)
    for text in ("one two three four five six", "one two seven", "one two eight nine", "one! two!! ten"):
        assert enc.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids


#: With tokenizers of their own to compare with.
ENCODERS = [(Encoder(public_tokenizers.path(n)), Tokenizer.from_file(public_tokenizers.path(n))) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]


def test_pieces_look_a_word_up_once(monkeypatch):
    """Texts of a batch are encoded together, with the library's ids; a word is looked up once for all its places."""
    rng = random.Random(6)
    words = ["stone", "Stone,", "über", "Ünter!", "x1", "don't", "a-b", "…", "日本", "\x1f", "\0", "#!", "stone.stone"]
    texts = [None, "", " \n ", "word " * 5000, "stone"] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\u00a0", ""]) for _ in range(rng.randint(1, 400))) for _ in range(80)]
    lib, want = Tokenizer.from_file(PATH), []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[start : start + 64], "<u4").tobytes()
            want.append((i, k, start, len(own) // 4, zlib.crc32(own), own))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], names=["doc_id", "text"]) for a, b in ((0, 3), (3, 3), (3, len(texts)))]
    got = pa.Table.from_batches(list(packing._pieces(PATH, 64, True)(iter(batches))))
    assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want

    asked = Counter()

    class Counted(_Words):
        def __getitem__(self, w):
            asked[w] += 1
            return super().__getitem__(w)

    enc = Encoder(PATH)
    enc.words = Counted(enc)
    monkeypatch.setattr(packing, "encoder", lambda *_: enc)
    some = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["stone, stone wall", "wall! " * 900, "stone wall."])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(PATH, 2048, False)(iter([some]))) == 3
    assert asked["stone"] == asked["wall"] == 1
