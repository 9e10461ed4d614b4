"""Files: dictionaries and folds split at byte ranges, matrices as CSV."""

import json
import math
import random
from collections import OrderedDict

import pytest

from affinity_jobs import io


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_a_dictionary_is_read_by_many_tasks_in_order(spark, tmp_path, small_splits):
    rng = random.Random(5)
    letters = ['"', "\\", "é", "\n", "{", "}", ":", ",", "C", "漢", " ", "\\\\", '\\"']
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    data = OrderedDict((f"{i}{word(4)}", word(60)) for i in range(300))
    path = tmp_path / "d.json"
    path.write_text(json.dumps(data, ensure_ascii=False, indent=1))
    assert spark.read.option("lineSep", '"').text(str(path)).rdd.getNumPartitions() > 50
    found = [tuple(r) for r in io.read_json_dict(spark, str(path), "k", "v").collect()]
    assert found == [(i, k, v) for i, (k, v) in enumerate(data.items())]


def test_repeated_keys_keep_the_first_place_and_the_last_value(spark, tmp_path, small_splits):
    text = "{" + ", ".join(f'"k{i % 37}": "v{i}"' for i in range(0, 500, 3)) + "}\n"
    (tmp_path / "d.json").write_text(text)
    want = json.loads(text, object_pairs_hook=OrderedDict)
    assert [tuple(r) for r in io.read_json_dict(spark, str(tmp_path / "d.json")).collect()] == [(i, k, v) for i, (k, v) in enumerate(want.items())]


@pytest.mark.parametrize("text, n", [("{}", 0), (" { } \n", 0), ("", 0), ('{"": ""}', 1)])
def test_small_dictionaries(spark, tmp_path, text, n):
    (tmp_path / "d.json").write_text(text)
    assert io.read_json_dict(spark, str(tmp_path / "d.json")).count() == n


@pytest.mark.parametrize("text", ['{"a": 1, "b": "x"}', '{"a": ["b"]}', '["a", "b"]', '{"a": "b", "c"}'])
def test_what_is_no_object_of_strings_is_an_error(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON object of strings"):
        io.read_json_dict(spark, str(tmp_path / "d.json")).collect()


def test_folds_are_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(6)
    folds = [[rng.randrange(10_000) for _ in range(rng.randrange(120))] for _ in range(9)] + [[]]
    folds[4] = []
    (tmp_path / "f.json").write_text(json.dumps(folds))
    found = [tuple(r) for r in io.read_folds(spark, str(tmp_path / "f.json"), "train").collect()]
    assert found == [("train", i, x) for i, fold in enumerate(folds) for x in fold]
    (tmp_path / "g.json").write_text(json.dumps(folds[0] * 3))
    assert [r.ordinal for r in io.read_folds(spark, str(tmp_path / "g.json"), "test").collect()] == folds[0] * 3
    (tmp_path / "h.json").write_text('[1, "x"]')
    with pytest.raises(Exception, match="not a list of ordinals"):
        io.read_folds(spark, str(tmp_path / "h.json"), "test").collect()


def test_a_matrix_as_csv(spark, tmp_path):
    rows = [(0, [1.5, None, float("nan")]), (2, [float("inf"), -1e-300, 0.1]), (3, [])]
    io.write_matrix(spark.createDataFrame(rows, "row_idx long, values array<double>"), str(tmp_path / "m"))
    found = sorted((r.row_idx, r["values"]) for r in io.read_matrix(spark, str(tmp_path / "m"), "csv").collect())
    assert found[0][1][:2] == [1.5, None] and math.isnan(found[0][1][2]) and found[1:] == [(2, [math.inf, -1e-300, 0.1]), (3, [])]
    (tmp_path / "h.csv").write_text("row_idx,a,b\n7, 1 ,NaN\n\n8,,2\n")
    assert [(r.row_idx, r["values"][0]) for r in io.read_matrix(spark, str(tmp_path / "h.csv"), "csv").collect()] == [(7, 1.0), (8, None)]
    (tmp_path / "b.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="CAST"):
        io.read_matrix(spark, str(tmp_path / "b.csv"), "csv").collect()


def test_pairs_keep_quotes_and_backslashes(spark, tmp_path):
    rows = [("C/C=C\\", 'a"b,c', "x\\", 1.5), ('"', "\\\"", " y ", None)]
    io.write_pairs(spark.createDataFrame(rows, io.PAIRS), str(tmp_path / "p"))
    assert sorted(map(tuple, io.read_pairs(spark, str(tmp_path / "p")).collect())) == sorted(rows)
