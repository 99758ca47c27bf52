"""Incremental ingestion from a folder."""

from __future__ import annotations

import tempfile

from lectern.streaming import ingest


def test_each_row_once_over_two_calls(spark, data):
    folder = tempfile.mkdtemp(prefix="spark-")
    source = spark.read.parquet(f"{data}/cards.parquet")
    source.limit(50).write.parquet(f"{folder}/in/one")
    schema = source.schema

    def run():
        rows = ingest.once(ingest.stream(spark, f"{folder}/in/*", schema), "card_id", "created_at")
        ingest.append_available(rows, f"{folder}/out", f"{folder}/state").awaitTermination()

    run()
    source.write.parquet(f"{folder}/in/two")
    run()
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == out.select("card_id").distinct().count() > 50
