import json

from arbora.__main__ import main
from arbora.operators import graph
from arbora.sources import files


def test_sequences_info_merge(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.nwk").write_text("((a,b),(c,d));")
    (tmp_path / "t/2.nwk").write_text("((a,c),(b,d));")
    (tmp_path / "s.fa").write_text(">a\nAC\n>b\nAT\n>c\nGC\n>d\nGT\n")
    (tmp_path / "ref.txt").write_text("AA\n")
    store = str(tmp_path / "out.parquet")
    main(["sequences", "--trees", str(tmp_path / "t"), "--fasta", str(tmp_path / "s.fa"), "--reference", str(tmp_path / "ref.txt"), "--output", store])
    assert graph.violations(files.read(spark, store)).count() == 0
    main(["info", store, "--distances"])
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["trees"] == 2 and told["least_sum_rf"] == told["most_sum_rf"] == 4 and told["least_parsimony"] <= told["most_parsimony"]
    assert set(files.LOG.values()) - set(told) == {"iteration", "seconds"} and 1 <= told["least_sum_rf_trees"] <= 2


def test_log_of_a_search(spark, tmp_path):
    row = {name: k for k, name in enumerate(files.LOG.values())}
    files.append_log(spark, [row, row], str(tmp_path / "whole"))
    whole = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "whole"))
    assert whole.columns == list(files.LOG) and [list(r) for r in whole.collect()] == [[str(k) for k in range(len(files.LOG))]] * 2
    files.append_log(spark, [{"iteration": 1, "parsimony": 7}], str(tmp_path / "part"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "part")).columns == ["iteration", "parsimony"]
