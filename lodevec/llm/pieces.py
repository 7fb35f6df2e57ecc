"""The public model that is used where none is given, and runs of whole texts for a worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodevec.llm.textbytes import buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def slices(texts: pa.Array, run_bytes: int = 1 << 20):
    """(first, last) of runs of whole texts of about ``run_bytes``."""
    _, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, side="right")) - 1)
        yield i, j
        i = j
