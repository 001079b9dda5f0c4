"""The GML data source: round trips, groups of files, malformed files."""

import pytest

from unravel.sources import gml, graph_files

TEXT = """Creator "x [ y"
# a comment
graph [
  directed 0
  node [ id 3 label "a b" weight 0.5 graphics [ x 1 y 2 ] ]
  node [
    id 1
  ]
  edge [ source 3 target 1 weight 0.25 ]
  edge [ source 1 target 7 ]
]
"""


@pytest.fixture(scope="module")
def source(spark):
    gml.register(spark)
    return spark


def test_parts_and_equality_with_the_text_reader(source, tmp_path):
    for k in range(5):
        (tmp_path / f"g2_{k}.gml").write_text(TEXT.replace("target 7", f"target {7 + k}"))
    (tmp_path / "notes.txt").write_text("no graph")
    read = source.read.format("gml").option("files", 2)
    edges = read.load(str(tmp_path))
    assert edges.rdd.getNumPartitions() == 3
    want = sorted(tuple(r) for r in graph_files.read_gml(source, f"{tmp_path}/*.gml")[1].collect())
    assert sorted((tuple(r) for r in edges.collect()), key=str) == sorted(want, key=str) and (2, 1, 1, 9, None) in want
    nodes = sorted(tuple(r) for r in read.option("part", "vertices").load(f"file://{tmp_path}").where("graph_id = 4").collect())
    assert nodes == [(4, 1, None, None), (4, 3, "a b", 0.5)]


def test_round_trip(source, tmp_path):
    rows = [(g, i, i, i + 1 + g, None if i == 2 else i / 8) for g in range(3) for i in range(4)]
    edges = source.createDataFrame(rows, gml.SCHEMAS["edges"])
    edges.repartition(2, "graph_id").sortWithinPartitions("graph_id", "edge_id").write.format("gml").mode("append").save(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in source.read.format("gml").load(f"{tmp_path}/out").collect()) == sorted(rows)


@pytest.mark.parametrize("text", ["graph [ node [ id 1 ]", "graph [ edge [ source 1 ] ]", "graph [ edge [ source a target 2 ] ]", "graph [ ] ]", "", "graph [ [ ] ]"])
def test_malformed(source, tmp_path, text):
    (tmp_path / "bad_1.gml").write_text(text)
    with pytest.raises(Exception, match="bad_1.gml is no well-formed graph"):
        source.read.format("gml").load(str(tmp_path)).collect()
