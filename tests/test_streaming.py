"""Results that arrive as files."""

import json

from tessera.streaming import results


def test_registry_follows_the_files(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def drop(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("candidate_id", "family", "sequence", "finished", "silhouette", "accepted"), r, strict=True))) for r in rows))

    def latest(n):
        return {r.candidate_id: r.silhouette for r in spark.read.parquet(str(tmp_path / "reg" / f"v{n}")).collect()}

    run = lambda: results.keep_registry(results.follow(spark, str(tmp_path / "in")), str(tmp_path / "reg"), str(tmp_path / "cp")).awaitTermination()
    drop("a.json", ("x", "classical", 1, "2024-01-01T00:00:00", 0.1, False), ("y", "deep", 1, "2024-01-01T00:05:00", 0.5, True))
    run()
    assert latest(0) == {"x": 0.1, "y": 0.5}
    drop("b.json", ("x", "classical", 2, "2024-01-01T00:30:00", 0.9, True), ("y", "deep", 0, "2024-01-01T00:31:00", 0.0, False))
    run()
    assert latest(1) == {"x": 0.9, "y": 0.5}
    drop("c.json", ("z", "deep", 1, "2024-01-01T00:40:00", 0.3, False))
    run()
    assert latest(2) == {"x": 0.9, "y": 0.5, "z": 0.3} and sorted(p.name for p in (tmp_path / "reg").iterdir()) == ["v1", "v2"]
    counts = results.finished_per_window(results.follow(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.family, r.results, r.accepted) for r in spark.table("per_window").collect()) == sorted([("classical", 1, 0), ("classical", 1, 1), ("deep", 1, 0), ("deep", 1, 1), ("deep", 1, 0)])
