"""Large CSV and JSON files are cut into the same records by any number of splits."""

import csv
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.sources import readers, splits, writers

TEXTS = ['plain', 'a, "b"', 'two\nlines', '"', '""', '\n', ' \n \n', 'x' * 400, '{"a": [1]}', '} ] { [', '\\', '\\"', 'tail\\', 'é字🙂', '', '","', "it's", '}\n}\n"}"']


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows(n, seed):
    rng = random.Random(seed)
    return [{"id": str(i), "text": "".join(rng.choice(TEXTS) for _ in range(rng.randrange(1, 4))) or "-", "more": rng.choice(TEXTS[:6])} for i in range(n)]


@pytest.mark.parametrize("size", [97, 5000])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, small_splits, size, indent):
    made = rows(150, 3)
    (tmp_path / "a.json").write_text(json.dumps(made[:120], indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({**made[120], "deep": {"list": [{"x": "}"}, []]}}, indent=indent), encoding="utf-8")
    (tmp_path / "c.json").write_text("[]", encoding="utf-8")
    (tmp_path / "d.json").write_text("\n\n [" + ",\n".join(json.dumps(r) for r in made[121:]) + "\n]\n", encoding="utf-8")
    small_splits(size)
    found = splits.json_records(spark, str(tmp_path)).collect()
    assert sorted((json.loads(r.record)["id"] for r in found), key=int) == [r["id"] for r in made]
    got = readers.read_page_json(spark, str(tmp_path), "id string, text string, more string").collect()
    assert {r.id: (r.text, r.more) for r in got} == {r["id"]: (r["text"], r["more"]) for r in made}
    order = [r.record for r in sorted(found, key=lambda r: (r.file, r.start, r.n))]
    assert [json.loads(r)["id"] for r in order] == [r["id"] for r in made]
    if size == 97:
        assert splits.json_records(spark, str(tmp_path / "a.json")).select("start").distinct().count() > 5


@pytest.mark.parametrize("size", [97, 5000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks(spark, tmp_path, small_splits, size, end):
    made = rows(150, 5)
    for name, part in (("a.csv", made[:100]), ("b.csv", made[100:])):
        with open(tmp_path / name, "w", encoding="utf-8-sig" if name == "a.csv" else "utf-8", newline="") as f:
            out = csv.DictWriter(f, ["id", "text", "more"], quoting=csv.QUOTE_ALL, lineterminator=end)
            out.writeheader()
            out.writerows(part)
    small_splits(size)
    got = readers.read_exported_csv(spark, str(tmp_path))
    assert got.columns == ["id", "text", "more"]
    assert {r.id: (r.text or "", r.more or "") for r in got.collect()} == {r["id"]: (r["text"], r["more"]) for r in made}
    if size == 97:
        assert splits.csv_records(spark, str(tmp_path / "a.csv")).select("start").distinct().count() > 5


def test_written_arrays_and_nothing_to_read(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit('"}{'), "id").alias("t")).repartition(3)
    writers.write_json_arrays(df, str(tmp_path / "j"))
    files = list((tmp_path / "j").glob("part-*"))
    assert len(files) == 3 and sum(len(json.loads(f.read_text())) for f in files) == 100
    back = readers.read_page_json(spark, str(tmp_path / "j"))
    assert sorted((r.id, r.t) for r in back.collect()) == [(i, f'"}}{{{i}') for i in range(100)]
    writers.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    assert splits.json_records(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_exported_csv(spark, str(tmp_path / "empty.csv")).count() == 0


def pieces_of(text, separator):
    values = text.split(separator)[:-1]
    rows = len(values)
    return pa.RecordBatch.from_pydict({"file": ["f"] * rows, "start": pa.array([0] * rows, pa.int64()), "value": values, "inside": pa.array([0] * rows, pa.int32()),
                                       "depth": pa.array([0] * rows, pa.int64()), "base": pa.array([1] * rows, pa.int32())})


def test_memory_of_a_batch_is_bounded():
    """An Arrow batch of many long records is looked at in short runs of pieces."""
    batch = pieces_of("[" + ",".join(json.dumps({"id": i, "text": "word, " * 2000}) for i in range(2500)) + "]}", "}")
    for step in (splits._effects(splits._Json), splits._cut(splits._Json)):
        tracemalloc.start()
        n = sum(b.num_rows for b in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n in (1, 2500) and peak < 2 * batch.nbytes        # 33 times the batch when it was looked at as a whole


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_runs_of_any_size_cut_the_same(monkeypatch, most):
    made = rows(200, 8)
    monkeypatch.setattr(splits.ranges, "__defaults__", (most,))
    found = [r for b in splits._cut(splits._Json)(iter([pieces_of("[" + ",".join(map(json.dumps, made)) + "}", "}")])) for r in b.to_pylist() if r["part"] == "whole"]
    assert [json.loads(r["record"]) for r in found] == made and [r["n"] for r in found] == list(range(200))
