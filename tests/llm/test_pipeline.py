import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from peerscreen.llm import secrets
from peerscreen.llm.common import fresh_path

from test_decontaminate import brute as hits  # isort: skip
from test_jaccard import brute as classes  # isort: skip
from test_quality_rules import brute as measures  # isort: skip
from test_secrets import RULES  # isort: skip

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(15)) for i in range(5)]
    texts = [say(rng.randint(12, 90)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", say(30) + " " + items[1][1] + " " + say(4), say(20) + " password = hunter22 " + "ab" * 14, "short", None, "", "x y z u v " * 9]
    docs = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    folder = fresh_path(spark, "corpus")
    spark.createDataFrame(docs, SHAPE).selectExpr("*", "'extra' as spans").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages_against_brute_force(spark, corpus):
    folder, docs, items = corpus
    rows = {r[0]: r for r in docs if not measures(r[1])[5]}
    keep = {c for _, c, _ in classes([(i, r[1]) for i, r in rows.items()])}
    rows = {i: r for i, r in rows.items() if i in keep}
    rows = {i: r for i, r in rows.items() if not hits([(i, r[1])], items)[0][4]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, r in rows.items():
        spans = sorted((m.start(), m.end()) for _, rule, passes in RULES for m in rule.finditer(r[1]) if passes(m))
        out, at = "", 0
        for a, b in spans:
            out += r[1][at:a] + secrets.MARK if a >= at else ""
            at = max(at, b)
        want[i] = tokenizer.encode(out + r[1][at:], add_special_tokens=False).ids
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_redaction_leaves_no_secret(spark, corpus):
    folder, _, _ = corpus
    out = corpus_pipeline.redaction(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert sum(secrets.MARK in (r.text or "") for r in out) == 1
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out)
    assert not any(re.search("hunter22", r.text or "") for r in out)
