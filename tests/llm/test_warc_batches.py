"""Archives read back in batches of bounded size, however well payloads are compressed."""

import pyarrow as pa
import pytest

from lendscope.llm import warc


@pytest.mark.parametrize("payloads", [True, False])
def test_batches_are_bounded(tmp_path, monkeypatch, payloads):
    monkeypatch.setattr(warc, "BATCH_ROWS", 40)
    texts = ["a" * 50_000] * 20 + ["b", ""] * 60
    rows, offset = [], 0
    with open(tmp_path / "x", "wb") as out:
        for k, text in enumerate(texts):
            member, _ = warc.encode(warc.Page(k, None, text.encode(), None))
            out.write(member)
            rows.append({"file": "x", "offset": offset, "length": len(member)})
            offset += len(member)
    read = warc._reader(tmp_path.as_uri(), warc.MAX_RANGE_BYTES, warc.MAX_GAP_BYTES, payloads, batch_bytes=200_000)
    batches = [b.to_pylist() for b in read(iter([pa.RecordBatch.from_pylist(rows)]))]
    got = [r for b in batches for r in b]
    assert [(r["page_id"], r["payload_bytes"]) for r in got] == [(k, len(t)) for k, t in enumerate(texts)]
    assert [r["payload"] for r in got] == (texts if payloads else [None] * len(texts))
    assert max(sum(r["payload_bytes"] for r in b) for b in batches) <= 250_000
    assert max(len(b) for b in batches) <= 40
