import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa

from loomtext.llm import packing, workers


def held() -> float:
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_pieces_do_not_copy_ids(spark, monkeypatch):
    """Two texts of 200,000 tokens in about a hundred pieces each: the ids of its text for each piece would be 80 MB."""
    kind = type(spark.range(0))
    calls, plain = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **k: (calls.append((self, run)), plain(self, run, *a, **k))[1])
    docs = spark.createDataFrame([(i, "a b " * 100_000, s) for i, s in ((1, "x"), (2, "y"))], "doc_id long, text string, source string").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas().sort_values(["doc_id", "start"])
    for _, g in got.groupby("doc_id"):
        assert g.length.sum() == 200_001 and g.start.tolist() == [0, *g.length.cumsum()[:-1]] and len(g) > 90

    frame, run = calls[-1]
    batches = frame.toArrow().to_batches()
    before, rows = pa.total_allocated_bytes(), 0
    for out in run(iter(batches)):
        rows += len(out)
        assert pa.total_allocated_bytes() - before < 10_000_000
    assert rows == len(got)


def test_tasks_give_memory_back():
    """What a task has freed below memory that is still in use goes back to the machine at its end."""
    kept = []

    def run(batches):
        for _ in batches:
            some = [bytes([i % 251]) * 100_000 for i in range(1_500)]
            kept.append(some[-1])
            yield len(some)

    before = held()
    assert list(workers.tidy(run)([1])) == [1_500]
    assert held() - before < 60
