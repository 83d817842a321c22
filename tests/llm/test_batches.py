import pyarrow as pa
import pytest

from pulse.llm import decontam, simhash, toxicity
from pulse.llm.common import text_slices


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_slices_hold_every_row_once_and_end_at_the_bytes():
    texts = ["a" * n for n in (3, 0, 5, 1, 1, 1, 20, 2)] + [None, "é", None]
    for most in (1, 4, 10, 1000):
        parts = list(text_slices(batch(texts), 1, most))
        assert pa.Table.from_batches(parts).to_pydict() == {"doc_id": list(range(len(texts))), "text": texts}
        sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in parts]
        assert all(sum(s[:-1]) < most for s in sizes) and all(sum(s) >= most for s in sizes[:-1])
    assert list(text_slices(batch([]), 1)) == []
    assert sum(p.num_rows for p in text_slices(batch(texts).slice(2, 5), 1, 2)) == 5


@pytest.mark.parametrize("operator", ["toxicity", "simhash", "decontam"])
def test_a_large_batch_is_returned_in_small_ones(spark, monkeypatch, operator):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    seen = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: seen.append((run, df)) or df)
    if operator == "toxicity":
        toxicity.with_score(docs, toxicity.ToxicityModel({b"=bad": 1.0}, -7.0), "score")
    elif operator == "simhash":
        simhash.with_fingerprint(docs, "print")
    else:
        decontam.mark_hits(docs, items)
    (run, df), = seen
    whole = batch(["some words " * 5000] * 200)     # 11 MB
    rest = {"__words": pa.array([0] * 200, pa.int64()), "__spans": pa.array([[]] * 200, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "__items": pa.array([[]] * 200, pa.list_(pa.int64()))}
    for name in df.columns[2:]:
        whole = whole.append_column(name, rest[name])
    out = list(run(iter([whole])))
    assert max(b.nbytes for b in out) < 4 << 20 and [i for b in out for i in b.column(0).to_pylist()] == list(range(200))
