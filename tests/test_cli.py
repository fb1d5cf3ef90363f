"""The command line's parts on small workloads."""

from logstrata import cli
from logstrata.operators import workload


def test_range_bench(spark, tmp_path):
    assert {(r.size, r.found) for r in cli.range_bench(spark, str(tmp_path)).collect()} == {(100, 100), (1000, 1000), (5000, 5000), (10_000, 10_000)}


def test_demo(spark, tmp_path, capsys):
    cli.demo(spark, str(tmp_path))
    shown = capsys.readouterr().out
    assert "birds 3" in shown
    assert "trees 1" in shown
    assert "[bird:heron, bird:stork) 2" in shown


def test_workload(spark, tmp_path):
    w = workload.Workload("balanced-uniform", 0.5, n_keys=50)
    row = cli.run_workload(spark, w, "levelled", str(tmp_path), 400, batches=2).first()
    assert (row.workload, row.layout) == ("balanced-uniform", "levelled")
    assert row.writes_per_s > 0
    assert row.reads_per_s > 0
