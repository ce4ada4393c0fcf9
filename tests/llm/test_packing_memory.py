"""How much packing holds at a time."""

from types import SimpleNamespace

import pyarrow as pa

from airlock.llm import packing


def test_packing_takes_few_texts_at_a_time(monkeypatch):
    """A batch of 2,000 texts, packed outside Spark: no more than 250 are encoded at once, and all are packed."""
    taken, sizes = {}, []
    docs = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))})
    docs.select = lambda *columns: docs
    docs.mapInArrow = lambda run, schema: taken.setdefault("run", run)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    real = packing.encoder
    monkeypatch.setattr(packing, "encoder", lambda path: SimpleNamespace(encode=lambda texts: (sizes.append(len(texts)), real(path).encode(texts))[1]))
    packing.pack(docs)
    batch = pa.record_batch([pa.array(range(2000)), pa.array([f"some words of text {k % 7} " * 100 for k in range(2000)])], ["doc_id", "text"])
    rows = [r for b in taken["run"](iter([batch])) for r in b.to_pylist()]
    assert sum(sizes) == 2000 and max(sizes) <= 250
    total = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert len(total) == 2000 and sum(total.values()) == sum(r["length"] for r in rows)
