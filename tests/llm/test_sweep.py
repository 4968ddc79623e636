"""A sweep takes few blocks at a time, however many reach it as one batch."""

import numpy as np
import pyarrow as pa

from veilspark.llm import lines


def test_a_sweep_takes_few_blocks_at_a_time(monkeypatch):
    texts = [f"one two three four five six seven eight w{k // 2} nine{k % 2}" for k in range(300)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    packed = pa.Table.from_batches(lines.packer(0.8, 1, np.full(lines.COUNTERS, 9, np.uint8), 170)([docs]))
    batch = packed.sort_by("bucket").combine_chunks().to_batches()[0]
    taken, cut = [], lines.slices
    monkeypatch.setattr(lines, "slices", lambda batches, rows=1024: (taken.append(b.num_rows) or b for b in cut(batches, rows)))
    swept = lambda parts: sorted(map(repr, (r for b in lines.sweeper(0.8, 170)(parts) for r in b.to_pylist())))
    got = swept([batch])
    assert taken and max(taken) <= 64 < batch.num_rows
    assert got and got == swept([batch.slice(k, 1) for k in range(batch.num_rows)])
