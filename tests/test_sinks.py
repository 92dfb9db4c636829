import os
from pathlib import Path

from lexframe.sources import corpus as C
from lexframe.sources.sinks import write_scripts


def test_scripts_are_files_of_their_own_written_by_the_tasks(spark, tmp_path):
    sources = ["", "a\nb", "ü = 1;", "x" * 70000, "a\nb", "end\n"]
    rows = [(f"{i}", s) for i, s in enumerate(sources)]
    out = str(tmp_path / "tree")
    write_scripts(spark.createDataFrame(rows, "script_id string, src string").repartition(3), out)
    assert len([f for f in os.listdir(out) if f.endswith(".txt")]) == len(sources)
    # Spark's writer leaves a checksum beside every file and a mark in the folder
    assert not [f for f in os.listdir(out) if not f.endswith(".txt")]
    got = [(r.ext, r.size, r.src) for r in C.scan_scripts(spark, Path(out).as_uri(), glob="*.txt").collect()]
    assert sorted(got) == sorted((".txt", len(s.encode()) + 1, s + "\n") for s in sources)


def test_no_script_is_no_file(spark, tmp_path):
    out = str(tmp_path / "none")
    write_scripts(spark.createDataFrame([], "script_id string, src string"), Path(out).as_uri())
    assert C.scan_scripts(spark, out, glob="*.txt").count() == 0
