import pytest

from fedlens.llm import catalogue

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, target_text string, target_lang string, align_score double, bundle string, pair_no long",
    "updates": "update_id long, round_id long, pos int, sender string, sequence long, gradients array<float>",
    "metrics": "schema_version int, ts_unix_nanos long, trace_id string, span_id string, name string, value double, unit string, attrs map<string,string>, ingested_at timestamp",
    "languages": "lang string, iso3 string, english_name string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "containers": "container_kind string, capacity_tokens int",
}


@pytest.mark.parametrize("full", [False, True])
def test_every_query_over_empty_tables(spark, tmp_path, full):
    """All tables empty, and then all but the small ones."""
    small = {"languages": [("en", "eng", "English")], "mix_targets": [("a", 1.0, 2)], "containers": [("small", 128)]} if full else {}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(small.get(name, []), schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name, query in catalogue.QUERIES.items():
        rows = query(spark, f"file://{tmp_path}").collect()
        assert len(rows) == (1 if name in ("p4_recall", "p4_holds", "p10_holds") else 2 * full if name in ("p9_shares", "p9_holds") else full if name in ("p8_fill", "p8_holds") else 0), name
