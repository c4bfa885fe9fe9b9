"""Parsers hold few blocks as Python objects at once."""

import pyarrow as pa

from tessera.sources import parsers


def test_documents_are_parsed_in_slices(monkeypatch):
    monkeypatch.setattr(parsers, "SLICE", 10)
    given = pa.array(["abcd", None, "efgh", "x" * 30, "", "y"])
    assert [p.to_pylist() for p in parsers.slices(given)] == [["abcd", None, "efgh"], ["x" * 30], ["", "y"]]
    seen = []
    (got,) = parsers._parsed(iter([given]), lambda t: seen.append(t) or ([("P", "1", t)] if t else []))
    assert got.to_pylist() == [[{"block_type": "P", "page_or_location": "1", "text_content": t}] if t else t if t is None else [] for t in given.to_pylist()]
    assert seen == ["abcd", "efgh", "x" * 30, "", "y"] and list(parsers._parsed(iter([pa.array([], pa.string())]), parsers.parse_markdown))[0].to_pylist() == []
