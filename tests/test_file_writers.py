"""Queries that write a file per row do so from all cores."""

from catalog import models, registry, scores, sources  # noqa: F401


class Stop(Exception):
    pass


def test_scoring_lists_are_written_by_all_cores(spark, monkeypatch, tmp_path):
    """Before, four tasks wrote the files, however many there were."""
    parts = []

    class World:
        def __init__(self, *_):
            self.spark = spark
            self.stored_firm_years = spark.range(400).selectExpr(
                "concat('d', id) as doc_id", "id as cik", "2000 as fyear", "'n' as name", "10 as sic", "id as total_assets"
            )

    def spread(df):
        made = real(df)
        parts.append((made.rdd.getNumPartitions(), made.count()))
        return made

    def stop(*_):
        raise Stop

    real = scores.spread
    monkeypatch.setattr(registry, "World", World)
    monkeypatch.setattr(scores, "spread", spread)
    monkeypatch.setattr(scores, "scratch", lambda *_: f"{tmp_path}/firms")
    monkeypatch.setattr(scores.jobs, "read_scoring_input", stop)
    registry.load_all()
    try:
        registry.QUERIES["src12_json_scoring_input"](spark, "")
    except Stop:
        pass
    assert [p >= 8 for p, _ in parts] == [True, True] and [n for _, n in parts] == [20, 4]
