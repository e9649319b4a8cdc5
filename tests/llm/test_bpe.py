import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from peerscreen.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_tokenizers_library(spark):
    rng = random.Random(1)
    letters = "aaabbcxyz  '\n\tséè1230-_=!日本　\x1c\x85🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["x<|endoftext|>y <|endoftext|>", "", "a" * 3000, " " * 500 + "b", "ab" * 2000, "they'll we're I'd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.decoded(bpe.encoded(df, PATH), PATH).orderBy("doc_id").collect()
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [r.token_ids for r in got] == [w.ids for w in want]
    assert [r.decoded for r in got] == texts


def test_trie_restarts_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    texts = ["prefix prefixes prefixed unprefixed", "prefer preferred", "zebra zebras " * 20]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):
        assert [encoder.encode([t]).to_pylist()[0] for t in texts] == want
    assert len(encoder.slot) < 20


def test_shared_prefixes_are_walked_once():
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    asked = []

    class Watched(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.vocabulary.ending = Watched(encoder.vocabulary.ending)
    encoder.walk(["abcdefgh", "abcdefgi"])
    assert sum(k == b"a" for k in asked) == 1 and b"c" in asked and sum(k[-1:] == b"c" and len(k) == 1 for k in asked) == 1


def test_edges(spark, hostile):
    rows = bpe.round_trip(hostile, PATH).collect()
    assert len(rows) == hostile.count()
    assert all(r.decoded == (r.text or "") and (r.token_ids == []) == (not r.text) for r in rows)
    assert bpe.encoded(hostile.limit(0), PATH).collect() == []
    ids = pa.array([[15496, None, -1, 999_999], None, [], [128 + 60]], type=pa.list_(pa.int32()))
    with open(PATH, encoding="utf-8") as f:
        assert bpe.Decoder(f.read()).decode(ids).to_pylist()[:3] == ["Hello", "", ""]


def test_query_covers_all_rows(spark):
    df = queries.QUERIES["op1_trie_bpe"](spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    tokenizer = Tokenizer.from_file(PATH)
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows[:60]:
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
