"""The data sources of model servers, over files."""

import json

import pytest

from tessera.sources import models


def test_listing_is_read_by_address_and_filtered_at_the_source(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"models": [{"name": "m1", "details": {"family": "llava", "parameter_size": "7B"}, "model_info": {"x.context_length": 8192}}, {"name": "m2"}]}) + "\n\n")
    b.write_text(json.dumps({"models": [{"name": "m3", "capabilities": ["Embedding"], "details": None, "model_info": None}]}) + "\n" + json.dumps({"models": []}) + "\n")
    urls = [f"file://{a}", f"file://{b}"]
    found = {r.model_identifier: (r.capabilities, r.context_length, r.parameter_size) for r in models.discovered(spark, urls).collect()}
    assert found == {"m1": (["TextGeneration", "Vision"], 8192, "7B"), "m2": (["TextGeneration"], 4096, None), "m3": (["TextGeneration", "Embedding"], 4096, None)}
    assert models.discovered(spark, []).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.model_identifier for r in models.discovered(spark, urls).filter("model_identifier = 'm3' AND context_length > 1").collect()] == ["m3"]
        assert models.discovered(spark, urls).filter("model_identifier = 'm3' AND model_identifier = 'm1'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    b.write_text('{"model": []}\n')
    with pytest.raises(Exception, match="malformed listing"):
        models.discovered(spark, urls).collect()


def test_tokens_go_on_after_a_restart(spark, tmp_path):
    file = tmp_path / "g.ndjson"
    file.write_text('{"response": "a"}\n\n{"response": "b", "done": false}\nno json\n[1]\n{"response": 3}\n{"response": "half')
    url = f"file://{file}"

    def run():
        models.tokens(spark, [url]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return [(r.line, r.token, r.done, r.error) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("line").collect()]

    first = [(0, "a", False, None), (2, "b", False, None), (3, None, None, "malformed line: JSONDecodeError"), (4, None, None, "malformed line: AttributeError"), (5, None, None, "malformed line: ValueError")]
    assert run() == first
    with file.open("a") as f:
        f.write(' now", "done": true}\n')
    assert run() == [*first, (6, "half now", True, None)]
    assert run() == [*first, (6, "half now", True, None)]
