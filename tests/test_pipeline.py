"""The whole flow on a handful of files."""

import json

from pyspark.sql import functions as F

from sonolog.plans import pipeline
from sonolog.schemas import API_META, ARTIST, CATALOG, LEDGER, TRACK


def test_pipeline(spark, tmp_path):
    history = tmp_path / "history"
    history.mkdir()
    plays = [
        {"ts": "2024-01-01T10:00:00Z", "ms_played": 60000, TRACK: "One", ARTIST: "A"},
        {"ts": "2024-01-02T10:00:00Z", "ms_played": 90000, TRACK: " one ", ARTIST: "a"},
        {"ts": "2024-01-03T10:00:00Z", "ms_played": 90000, TRACK: "Two", ARTIST: "B"},
        {"ts": "2024-01-04T10:00:00Z", "ms_played": 90000, TRACK: "Three", ARTIST: "C"},
        {"ts": "2024-01-05T10:00:00Z", "ms_played": 90000, "episode_name": "E"},
        {"ts": "2024-01-06T10:00:00Z", "ms_played": 10, TRACK: "Short", ARTIST: "D"},
    ]
    (history / "Streaming_History_1.json").write_text(json.dumps(plays))
    names = CATALOG.fieldNames()
    rows = [["one", "a", "first"], ["ONE", "A", "second"]]
    body = "\n".join(",".join(r + [""] * (len(names) - 3)) for r in rows)
    (tmp_path / "catalog.csv").write_text(",".join(names) + "\n" + body + "\n")
    meta = [{TRACK: "two", ARTIST: "b", "spotify_id": "s2", "key": "two|||b"}]
    spark.createDataFrame(meta, API_META).write.parquet(str(tmp_path / "meta"))
    done = spark.createDataFrame([("two|||b", "{}", None)], LEDGER)
    done.write.parquet(str(tmp_path / "ledger"))
    inputs = pipeline.Inputs(*(str(tmp_path / n) for n in ("history", "catalog.csv", "meta", "ledger")))

    made = pipeline.build(spark, inputs)
    assert made["cleaned"].count() == 5
    assert [r[TRACK] for r in made["work_queue"].collect()] == ["Three"]
    assert made["match_rate"].first().matched_pairs == 2
    final = {r[TRACK]: r for r in made["final"].collect()}
    assert final["One"].track_id == final[" one "].track_id == "first"
    assert (final["Two"].spotify_id, final["Three"].metadata_source, final[None].media_type) == ("s2", "none", "podcast")

    out = str(tmp_path / "out")
    assert pipeline.publish(spark, inputs, out) == {
        "cleaned": 5, "catalog_enriched": 5, "api_enriched": 5, "song": 4, "podcast": 1,
    }
    for name in pipeline.PREFERENCE:
        assert pipeline.readers.load_first_available(spark, [f"{out}/{name}"]).count() == 5
    assert pipeline.load(spark, out).where("media_type = 'song'").count() == 4
    assert pipeline.refresh(spark, out, inputs.metadata).where(F.col("spotify_id").isNotNull()).count() == 1
