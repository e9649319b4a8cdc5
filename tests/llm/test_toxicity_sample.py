from pyspark.sql import functions as F

from peerscreen.llm import toxicity


def test_bounds_hold_when_one_id_has_most_rows(spark):
    """One labelled id holds nine tenths of the rows, some of them repeated."""
    ids = list(range(400))
    docs = spark.createDataFrame([(i, f"text number {i}") for i in ids] + [(1, f"one of many texts {i % 3000}") for i in range(3600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert not docs.where("doc_id = 1").select(toxicity.held_out(F.col("doc_id"))).first()[0]
    for rows, chars in ((50, 10**6), (10**6, 900), (200, 2000)):
        got = toxicity.sampled(docs, labels, rows, chars).collect()
        assert 0 < len(got) <= rows and sum(len(r.text) for r in got) <= chars
    everything = toxicity.sampled(docs, labels, 10**6, 10**9).collect()
    assert len({r.text for r in everything}) == len(everything) > 3000


def test_small_shares_still_draw(spark):
    """A share of less than a millionth draws what it says."""
    docs = spark.range(3_000_000).selectExpr("id as doc_id", "'t' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    got = [len(toxicity.sampled(docs, labels, n, 10**9).collect()) for n in (1, 2, 12)]
    assert got[0] <= 1 <= got[1] <= 2 and 1 <= got[2] <= 12
