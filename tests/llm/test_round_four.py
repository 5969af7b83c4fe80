"""What the pipeline's stages hold at a time."""

import numpy as np

from ashlar.llm import packing


def test_packed_rows_go_out_in_small_batches():
    """1000 full windows made one batch of 16 MB before."""
    docs = [(i, np.full(packing.WINDOW * 10 + 5, i, np.uint32)) for i in range(100)]
    sequences = packing.pack_group(docs)
    batches = list(packing.batches_of(docs, sequences, 7))
    assert max(b.nbytes for b in batches) < 1_200_000
    rows = [r for b in batches for r in b.to_pylist()]
    assert {r["sequence_id"] for r in rows} == set(range(7, 7 + len(sequences)))
    for i, (_, ids) in enumerate(docs):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == ids.tobytes() and all(r["doc_tokens"] == len(ids) for r in own)
