"""What one task of an operator holds beside its batch."""
import tracemalloc

import pyarrow as pa

from bidframe.llm import jaccard_join as jj


def test_summary_holds_little():
    """A task that meets many different words and shingles keeps few of either at once."""
    words = jj._Words()
    words.of(" ".join(f"w{i}" for i in range(250_000)))
    assert len(words) <= 100_001
    texts = [" ".join(f"{i}x{j}" for j in range(2_000)) for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    del texts
    tracemalloc.start()
    try:
        found = list(jj._summary(4)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = {k: sum(n for b in found for kind, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) if kind == k)
              for k in (0, 1)}
    assert counts == {0: 1_400_000, 1: 0}, counts
    assert peak < 70e6, peak
