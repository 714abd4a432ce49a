import corpus_pipeline as c
from collonade.llm import pii, quality, simhash, toxicity
from collonade.llm.common import keep, table

from pyspark.sql import functions as F


def test_stages_against_their_operators(spark, data):
    docs = table(spark, data, "documents")
    labels = table(spark, data, "labels")
    for name, stage in c.STAGES:
        out = keep(stage(spark, docs, data), f"test-{name}")
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        if name == "quality":
            want = quality.digests(docs, quality.learn(docs, labels)).where("predicted = 1")
            assert ids(out) == ids(want)
        elif name == "toxicity":
            assert ids(out) == ids(toxicity.digests(docs, toxicity.learn(docs, labels)).where("predicted = 0"))
        elif name == "near-dedup":
            assert ids(out) == sorted({r.component_id for r in simhash.group(docs, c.STAGE_SHINGLE).collect()})
        elif name == "pii":
            assert ids(out) == ids(docs)
            left = pii.find(out).agg(F.sum(F.size("base"))).first()[0]
            assert left == 0
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        if name != "packing":
            assert out.columns == c.COLUMNS
        docs = out


def test_odd_rows(spark, odd, nothing, data):
    for rows in (odd, nothing):
        docs = rows
        for name, stage in c.STAGES:
            docs = keep(stage(spark, docs, data), f"odd-{name}")
        assert docs.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]
        assert (docs.count() > 0) == (rows is odd)


def test_no_row_is_lost_for_its_id(spark, data):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    # Two texts without an id, one id with two texts, copies with and without an id, and a row repeated as a whole.
    rows = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (8, text(5)), (None, text(5)), (3, text(6)), (3, text(6)), (None, text(7)), (None, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((str(r.doc_id), r.text) for r in c.one_of_each_group(spark, docs, data).collect())
    want = [(None, 1), (None, 2), (7, 3), (7, 4), (8, 5), (3, 6), (None, 7)]
    assert got == sorted((str(i), text(k)) for i, k in want)
