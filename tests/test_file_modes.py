"""How the heads of many and of large files are read."""

import uuid

from filingrisk.sources import firm_years, json_arrays


def test_small_files_share_tasks(spark, tmp_path):
    """Before, every file was a task of its own."""
    for i in range(60):
        text = '[{"cik": "%d"}, {"cik": "x"}]' % i if i % 2 else '[\n{"cik": "%d"},\n{"cik": "x"}\n]' % i
        (tmp_path / f"f{i}.json").write_text(text)
    (tmp_path / "blank.json").write_text("\n \n")
    (tmp_path / "empty.json").write_text("")
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    modes = json_arrays.file_modes(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("tests", "tests")
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) < 30
    assert len(modes[json_arrays.WHOLE]) == 30 and len(modes[json_arrays.LINES]) == 31
    read = firm_years.read_firm_years(spark, str(tmp_path))
    assert read.count() == 120 and read.where("cik = 'x'").count() == 60


def test_large_and_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "SMALL_FILE", 100)
    for size in (10, 400):
        (tmp_path / f"whole{size}.json").write_text('[{"cik": "1", "mda": "%s"}]' % ("a" * size))
        (tmp_path / f"lines{size}.json").write_text('[\n{"cik": "1", "mda": "%s"}\n]' % ("a" * size))
    modes = json_arrays.file_modes(spark, str(tmp_path))
    assert [len(modes[m]) for m in (json_arrays.LINES, json_arrays.WHOLE)] == [2, 2]
    assert firm_years.read_firm_years(spark, str(tmp_path)).count() == 4


def test_one_kind_alone(spark, tmp_path):
    """All files of one kind are read by their folder."""
    for name, text in (("whole", '[{"cik": "1"}, {"cik": "2"}]'), ("lines", '[\n{"cik": "1"},\n{"cik": "2"}\n]')):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.json").write_text(text)
        (tmp_path / name / "empty.json").write_text("")
        assert firm_years.read_firm_years(spark, str(tmp_path / name)).count() == 6
