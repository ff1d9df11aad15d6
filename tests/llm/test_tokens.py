"""Token files, packing and pieces against the libraries themselves and exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import packing, pieces, token_store
from lattica.llm.common import shared_path
from lattica.llm.tokenize import ChunkTokenizer, vocabulary_path

PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "'s", "1", " ", "　", "!!", "日", " x", "Σ", " ", "\x1c", "\x85", "İ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "ing", "the", "▁", "😀", "\x00"]


def mixed(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 30))) for _ in range(n)] + ["", " ", "\n", "a ", "x" * 3000, "a b " * 2000]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_equal_whole_texts(name, leading):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path(name))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = mixed(1500) + [f"foo {x} bar" for x in added] + added + [x * 3 for x in added] + [f"{x}\n {x} " for x in added] + ["".join(added) + "a " + "".join(reversed(added))]
    t = ChunkTokenizer(vocabulary_path(name), leading)
    for _ in range(2):  # also from the cache
        ids, counts = t.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert all(p.tolist() == whole.encode(x, add_special_tokens=False).ids for p, x in zip(parts, texts))


def test_forgetting_keeps_results(monkeypatch):
    from lattica.llm import tokenize

    monkeypatch.setattr(tokenize, "CACHE_CHUNKS", 50)
    t, u = (ChunkTokenizer(vocabulary_path("byte_bpe_50k.json"), True) for _ in range(2))
    for seed in range(5):
        texts = pa.array(mixed(60, seed))
        a = t.encode(texts)
        monkeypatch.setattr(tokenize, "CACHE_CHUNKS", 10**9)
        b = u.encode(texts)
        monkeypatch.setattr(tokenize, "CACHE_CHUNKS", 50)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


@pytest.mark.parametrize("top", [3, 300, 70_000, 2**25])
def test_codec(top):
    ids = np.random.default_rng(top).zipf(1.3, 5001).clip(0, top).astype(np.uint32)
    vocab, control, data = token_store.pack_ids(ids)
    assert (token_store.unpack_ids(vocab, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ids)) == ids).all()
    counts = Counter(ids.tolist())
    assert [counts[v] for v in vocab.tolist()] == sorted(counts.values(), reverse=True)


def test_empty_codec():
    vocab, control, data = token_store.pack_ids(np.zeros(0, np.uint32))
    assert len(token_store.unpack_ids(vocab, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 0)) == 0


ROWS = [(3, "c d"), (4, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (1, None), (2, "a b c"), (2, "again"), (None, "no id"), (7, ""), (9, "z " * 5000)]


def test_token_files(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in ROWS], "doc_id long, text string, start int, ids string")
    path = shared_path(spark, "t")
    token_store.write_tokens(docs, path, vocabulary_path("byte_bpe_50k.json"), 2)
    got = {(r["doc_id"], r["start"]): r for r in token_store.token_index(spark, path).collect()}
    assert len(got) == len(ROWS)
    start = 0
    for i, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[i, start]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    texts = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in token_store.read_tokens(spark, path).collect()}
    assert whole.decode(texts[3].tolist()[:-1]) == "c d"


def test_empty_token_files(spark):
    path = shared_path(spark, "t")
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary_path("byte_bpe_50k.json"), 2)
    assert token_store.token_index(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 64, 200])
    counts = {n: rnd.randrange(1, 60) for n in range(1, cap + 1) if rnd.random() < rnd.choice([0.1, 0.5, 1])}
    used, boxes = Counter(), 0
    for times, lengths in packing.plan_packing(counts, cap):
        assert 0 < sum(lengths) <= cap
        boxes += times
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    assert boxes <= sum(counts.values())


def test_plan_is_tight_with_small_pieces():
    counts = {n: 40 for n in range(1, 129)}
    boxes = sum(t for t, _ in packing.plan_packing(counts, 2048))
    assert boxes == -(-sum(n * c for n, c in counts.items()) // 2048)


def test_exact_complements_come_first():
    plan = packing.plan_packing({7: 5, 3: 5, 5: 2, 4: 1, 2: 1}, 10)
    assert (5, (7, 3)) in plan and sum(t for t, _ in plan) == 7


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in ROWS * 3], "doc_id long, text string, length int")
    made = packing.make_pieces(docs, vocabulary_path("word_bpe_49k.json"), 0, keep_ids=True)
    from lattica.llm.common import staged

    made = staged(made, "p")
    out = packing.pack(made)
    rows = out.collect()
    assert len(rows) == made.count()
    by_box: dict = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"]
        by_box.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for entries in by_box.values():
        at = 0
        for offset, length in sorted(entries):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_box) == -(-sum(r["length"] for r in rows) // 2048)
    boxes = packing.sequences(out).collect()
    assert len(boxes) == len(by_box) and all(len(b["ids"]) == 4 * b["length"] for b in boxes)


def test_packing_of_whole_texts(spark):
    """Every piece is a slice of the library's ids of the whole text; few sequences more than the least there can be."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rnd = random.Random(11)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    docs = [(i, " ".join(rnd.choice(["some", "words", "ünd", "12", "x.", *added]) for _ in range(int(3 * 1.9 ** rnd.randrange(1, 12))))) for i in range(150)] + [(500, None), (501, ""), (7, "again")]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = Counter()
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((i, k, 2048 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids[s : s + 2048] for s in range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    boxes = len({r["sequence_id"] for r in out})
    assert boxes <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_empty_packing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    texts = [*mixed(1500, 4), "\né the", "▁ 😀", "   ", "=====" * 9, "<s> </s> <0x0A>"]
    ids, counts = own.encode(pa.array(texts))
    for got, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts):
        assert got.tolist() == lib.encode(text)
        assert own.decode(got) == lib.decode(got.tolist())


def test_pieces_query(spark):
    path = vocabulary_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, ids string")
    encoded = pieces.encode(docs, path)
    back = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"]) for r in pieces.decode(encoded, path).collect())
    assert back == sorted(((i is not None, i or 0), t or "") for i, t in ROWS)
    assert pieces.decode(pieces.encode(docs.limit(0), path), path, digest=True).count() == 0
