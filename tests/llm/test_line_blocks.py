"""op7 works on small blocks of text; what it finds does not depend on them."""

import pyarrow as pa
import pytest

from tallyforge.llm import _vec, line_dedup

TEXTS = [("a line of some words that comes again, as lines of forms and footers do\n" * 3) + f"and one of document {i % 4000}, told at greater length than the rest of it" for i in range(6000)]


def rows(monkeypatch, size):
    seen, blocks = [], _vec.blocks

    def watched(column, size=_vec.BLOCK_BYTES):
        for lo, hi, block in blocks(column, size):
            seen.append(len(block.data))
            yield lo, hi, block

    monkeypatch.setattr(_vec, "blocks", watched)
    if size:
        monkeypatch.setattr(line_dedup, "BLOCK_BYTES", size)
    batch = pa.record_batch({"id": pa.array(range(len(TEXTS)), pa.int64()), "key": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS)})
    out = [tuple(r.values()) for part in line_dedup._lines(batch) for r in part.to_pylist()]
    return sorted(out, key=repr), seen


def test_blocks_fit_a_cache(monkeypatch):
    assert max(rows(monkeypatch, None)[1]) <= 1 << 18


@pytest.mark.parametrize("size", [1, 1 << 14, 1 << 22])
def test_rows_do_not_depend_on_blocks(monkeypatch, size):
    with monkeypatch.context() as m:
        want = rows(m, 1 << 18)[0]
    assert rows(monkeypatch, size)[0] == want
