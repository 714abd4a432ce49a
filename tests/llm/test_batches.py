from types import SimpleNamespace

import pyarrow as pa
import pytest

from collonade.llm import packing, simhash, toxicity
from collonade.llm.queries import vocabulary

STEPS = {
    "fingerprints": lambda df: simhash.fingerprints(df, 3),
    "sets": lambda df: simhash.shingle_sets(df, 5),
    "prefixes": lambda df: simhash.with_prefixes(df, 5, 0.8),
    "toxicity": lambda df: toxicity.score(df.select("text", "doc_id"), {"trigrams": {}, "weights": {"text": 1.0}, "bias": -1.0}),
    "tokens": lambda df: packing.tokenise(df, vocabulary()),
}


@pytest.mark.parametrize("step", STEPS)
def test_a_large_batch_is_worked_on_in_parts(spark, monkeypatch, step):
    """A worker holds a few rows as Python objects, whatever a batch holds, and gives all of them in their order."""
    runs = []
    docs = spark.createDataFrame([(0, "some text")], "doc_id bigint, text string")
    of = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: runs.append(run) or of(self, run, *a, **b))
    STEPS[step](docs)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    ids, texts = pa.array(range(1000), pa.int64()), pa.array([f"text {i % 7} of {i}" if i % 9 else None for i in range(1000)])
    columns = {"sets": [texts], "toxicity": [texts, texts, ids]}.get(step, [ids, texts])
    batch = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    got = list(runs[-1](iter([batch])))
    assert max(b.num_rows for b in got) <= 256
    one_by_one = list(runs[-1](batch.slice(i, 1) for i in range(1000)))
    assert pa.Table.from_batches(got).combine_chunks() == pa.Table.from_batches(one_by_one).combine_chunks()


def test_no_links_take_no_python_rows(spark, monkeypatch):
    """A start without links is made by Spark alone: rows from Python take a daemon and workers of their own in each executor."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(20)] + [(20, " ".join(f"w0x{k}" for k in range(20)) + " more")], "doc_id bigint, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows from Python"))
    assert {r.doc_id: r.component_id for r in simhash.group(docs, 5).collect()} == {i: i % 20 for i in range(21)}
