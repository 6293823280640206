"""Records of pages of which a third hold one payload, joined by broadcast and, salted, by shuffle."""

import base64
import hashlib

import pytest

from quillspark.llm import warc


@pytest.mark.parametrize("most", [warc.BROADCAST_ROWS, 0])
def test_revisits_of_hot_payloads(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    html = lambda k: None if k % 3 == 0 else "ü" if k % 3 == 1 and k < 60 else f"page {k}"
    pages = [(k, f"http://h/{k}", html(k)) for k in range(120)] + [(None, None, None), (119, "http://h/119", html(119))]
    payload = lambda text: (text or "").encode()
    last, times = {}, {}
    for k, _, text in pages:
        times[payload(text)] = times.get(payload(text), 0) + 1
        last[payload(text)] = max(last.get(payload(text), -1), -1 if k is None else k)
    want = []
    for k, _, text in pages:
        raw = payload(text)
        revisit = times[raw] > 1 and last[raw] >= 0 and k != last[raw]
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last[raw] if revisit else None))
    got = warc.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
