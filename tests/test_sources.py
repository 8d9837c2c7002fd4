"""Readers, writers and the resumed stream."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomwright.sources import files, seek, snapshot
from loomwright.streaming import resume


def test_jsonl_rows_keep_their_places(spark, tmp_path):
    (tmp_path / "b.jsonl").write_bytes(b'{"a": 1}\n\n  \n{"a": "\xe2\x80\xa8"}\n')
    (tmp_path / "a.jsonl").write_bytes(b'{"a": 3}')
    rows = files.read_jsonl(spark, str(tmp_path))
    assert sorted((r["source_file"], r["source_row"], r["source_offset"]) for r in rows.collect()) == [("a.jsonl", 0, 0), ("b.jsonl", 0, 0), ("b.jsonl", 1, 13)]
    assert files.read_jsonl_plain(spark, str(tmp_path)).count() == 3
    want = spark.createDataFrame([("b.jsonl", 1)], "source_file string, source_row long")
    assert files.lookup(rows, want).count() == 1
    with pytest.raises(Exception, match="no such row: b.jsonl 9"):
        files.lookup(rows, spark.createDataFrame([("b.jsonl", 9)], "source_file string, source_row long")).collect()
    (tmp_path / "c.jsonl").write_text("{")
    with pytest.raises(Exception, match="c.jsonl row 0"):
        files.read_jsonl(spark, str(tmp_path)).collect()


def test_large_shards_are_split(spark, tmp_path):
    """Places over many splits are those of a plain reader."""
    rng = random.Random(3)
    want = []
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl"):
        row, offset, out = 0, 0, b""
        for _ in range(0 if name[0] == "e" else 3000):
            line = rng.choice(["", "  ", json.dumps({"x": "é\u2028" * rng.randrange(20)}, ensure_ascii=False), "[1]"]).encode()
            if line.strip():
                want.append((name, row, offset, line.decode()))
                row += 1
            offset += len(line) + 1
            out += line + b"\n"
        (tmp_path / name).write_bytes(out)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_jsonl(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5 and sorted(map(tuple, rows.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="no .*jsonl"):
        files.read_jsonl(spark, str(tmp_path / "none"))


def test_json_objects_and_csv(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert files.read_json_objects(spark, str(tmp_path)).count() == 1
    (tmp_path / "y.json").write_text("[1]")
    with pytest.raises(Exception, match="not an object"):
        files.read_json_objects(spark, str(tmp_path)).collect()
    d = spark.createDataFrame([("a", ["x", "y"], None)], "id string, c array<string>, n long")
    files.write_manifest_csv(d, str(tmp_path / "m.csv"), ["id", "c", "n", "absent"])
    assert (tmp_path / "m.csv").read_bytes() == b"id,c,n,absent\r\na,x|y,,\r\n"
    assert files.read_csv(spark, str(tmp_path / "m.csv")).first()["c"] == "x|y"


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b").write_bytes(b"22")
    (tmp_path / "a").write_bytes(b"1")
    m = files.dataset_manifest(spark, "n", "1", tmp_path, ["d/b", "a"], {})
    assert [f["path"] for f in m["files"]] == ["a", "d/b"] and m["total_bytes"] == 3
    assert files.verify_files(str(tmp_path), m["files"]) == []
    (tmp_path / "a").write_bytes(b"2")
    assert files.verify_files(str(tmp_path), m["files"]) == ["a: sha256"]
    for bad in ("../x", "/etc/hosts"):
        with pytest.raises(ValueError):
            files.under_root(tmp_path, bad)


def test_cases_and_prompts(spark, tmp_path):
    d = spark.createDataFrame([("CASE-0001", None)], "case_id string, pair_id string")
    assert files.write_case_files(d, str(tmp_path)) == 1
    assert json.loads((tmp_path / "CASE-0001.json").read_text()) == {"case_id": "CASE-0001", "pair_id": None}
    (tmp_path / "CASE-0009.json").write_text("{}")
    with pytest.raises(Exception, match="stale"):
        files.write_case_files(d, str(tmp_path))
    (tmp_path / "p.md").write_text("# System\nbe\n# User\n{thought}\n")
    assert files.read_prompts(str(tmp_path / "p.md")) == files.Prompts("be", "{thought}")
    (tmp_path / "p.md").write_text("# System\n\n# User\nx\n")
    with pytest.raises(ValueError):
        files.read_prompts(str(tmp_path / "p.md"))


def test_case_files_are_put_in_place_together(spark, tmp_path):
    """By tasks; nothing of a write that fails stays, what is there is replaced as a whole, and no staging is left."""
    rows = [(f"CASE-{k:04d}", k, [f"é{k}"]) for k in range(300)]
    d = spark.createDataFrame(rows, "case_id string, n long, x array<string>").repartition(7)
    folder = tmp_path / "cases"
    assert files.write_case_files(d, str(folder)) == 300
    assert all(json.loads((folder / f"{c}.json").read_text()) == {"case_id": c, "n": n, "x": x} for c, n, x in rows)
    for bad, problem in ((d.unionByName(d.limit(1)), "repeated|File exists"), (d.unionByName(spark.createDataFrame([("CASE-9/9", 1, None)], d.schema)), "no name of a file"), (d.where("n < 100"), "stale")):
        with pytest.raises(Exception, match=problem):
            files.write_case_files(bad.withColumn("n", F.lit(-1).cast("long")), str(folder))
        assert json.loads((folder / "CASE-0007.json").read_text())["n"] == 7
        assert sorted(p.name for p in folder.iterdir()) == [f"{c}.json" for c, *_ in rows]
    assert files.write_case_files(d.withColumn("n", F.lit(5).cast("long")), str(folder)) == 300
    assert json.loads((folder / "CASE-0007.json").read_text())["n"] == 5


class Feed:
    """Files of units, each followed by a run over what is new."""

    def __init__(self, spark, folder, step=lambda d: d, **options):
        self.spark, self.folder, self.step, self.options = spark, folder, step, options
        (folder / "in").mkdir()

    def __call__(self, name, *units):
        (self.folder / "in" / name).write_text("\n".join(json.dumps({"unit_id": u, "n": None if u == "b" else k, "x": {"y": [k]}}) for k, u in enumerate(units)))
        self.query = resume.process_new(self.spark, str(self.folder / "in"), "unit_id string, n long, x struct<y: array<long>>", str(self.folder / "log"), str(self.folder / "check"), {"m": 1}, self.step, **self.options)
        self.query.awaitTermination(60)
        return sorted(r["unit_id"] for r in self.log().collect())

    def log(self):
        return self.spark.read.parquet(f"{self.folder}/log/run={resume.run_id({'m': 1})}")


def test_stream_does_each_unit_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed("1.json", "a", "b", "a") == ["a", "b"]
    assert feed("2.json", "b", "c") == ["a", "b", "c"]
    assert {(r["unit_id"], r["n"], r["x"]["y"][0]) for r in feed.log().where("unit_id <> 'a'").collect()} == {("b", None, 1), ("c", 1, 1)}
    state = feed.query.lastProgress.stateOperators[0]
    assert state.numRowsTotal == 3  # the state is the units, whatever the log holds
    assert resume.run_id({"m": 1}) != resume.run_id({"m": 2})


def test_stream_after_a_failed_batch(spark, tmp_path):
    """The state of a batch that fails is lost with it: no unit is left out, none is done twice."""
    broken = [True]

    def step(d):
        if broken[0] and d.where("unit_id = 'd'").count():
            raise OSError("no device")
        return d

    feed = Feed(spark, tmp_path, step)
    assert feed("1.json", "a", "b") == ["a", "b"]
    with pytest.raises(Exception, match="no device"):
        feed("2.json", "b", "c", "d")
    assert sorted(r["unit_id"] for r in feed.log().collect()) == ["a", "b"]
    broken[0] = False
    assert feed("3.json", "d", "e") == ["a", "b", "c", "d", "e"]


def test_stream_forgets_old_units(spark, tmp_path):
    """A unit leaves the state once a later batch has moved the time on by as much as it is kept."""
    feed = Feed(spark, tmp_path, keep="1 second")
    assert feed("1.json", "a", "c", "c") == ["a", "c"]
    assert feed("2.json", "a", "b") == ["a", "b", "c"]
    time.sleep(2.5)
    assert feed("3.json", "d") == ["a", "b", "c", "d"]
    assert feed("4.json", "a", "d") == ["a", "a", "b", "c", "d"]
    assert feed.query.lastProgress.stateOperators[0].numRowsTotal <= 2


def test_lookup_reads_few_bytes(spark, tmp_path):
    """100 rows of 12 shards, under 1 % of their bytes; the same rows as a whole pass gives."""
    rng = random.Random(4)
    for k in range(12):
        with open(tmp_path / f"s{k:02d}.jsonl", "w", encoding="utf-8") as f:
            for j in range(30_000):
                f.write(("" if j % 50 else " \n\n") + json.dumps({"k": k, "j": j, "t": "é" * rng.randrange(20, 60)}, ensure_ascii=False) + "\n")
    places = files.read_jsonl(spark, str(tmp_path))
    index = seek.sparse_index(places, 8).persist()
    want = [(f"s{rng.randrange(12):02d}.jsonl", rng.randrange(30_000)) for _ in range(98)] + [("s00.jsonl", 0), ("s11.jsonl", 29_999)]
    selected = spark.createDataFrame(want + want[:3], "source_file string, source_row long")
    got = seek.lookup_rows(str(tmp_path), selected, index, 8).collect()
    assert sum(r["bytes_read"] for r in got) < 0.01 * sum(p.stat().st_size for p in tmp_path.glob("*.jsonl"))
    assert {(r["source_file"], r["source_row"]) for r in got} == set(want) and len(got) == len(set(want))
    assert all(json.loads(r["value"])["j"] == r["source_row"] and json.loads(r["value"])["k"] == int(r["source_file"][1:3]) for r in got)
    plain = {tuple(r) for r in files.lookup(places, selected).select("source_file", "source_row", "source_offset", "value").collect()}
    assert {tuple(r)[:4] for r in got} == plain
    for bad in (("s00.jsonl", 30_000), ("s00.jsonl", 999_999), ("other.jsonl", 0)):
        with pytest.raises(Exception, match="no such row"):
            seek.lookup_rows(str(tmp_path), spark.createDataFrame([bad], "source_file string, source_row long"), index, 8).collect()
    assert seek.lookup_rows(str(tmp_path), selected.limit(0), index, 8).collect() == []
    index.unpersist()


def test_keyed_json_lines(spark, tmp_path):
    path = tmp_path / "w.jsonl"
    path.write_text('{"unit_id": "a", "status": "completed", "pairs": [{"intent_id": "I1", "action_id": "A", "operation_match": "no"}]}\n')
    assert files.read_units(spark, str(path)).first()["pairs"][0]["operation_match"] == "no"
    for text, problem in (('{"unit_id": "a"}\n{"unit_id": "a"}\n', "repeated unit_id: a"), (" \n", "no rows"), ("[1]\n", "not an object"), ("{\n", "not an object")):
        path.write_text(text)
        with pytest.raises(Exception, match=problem):
            files.read_units(spark, str(path)).collect()


def test_reports_are_not_replaced(tmp_path):
    files.write_report({"a": 1}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        files.write_report({"a": 2}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}


def test_a_folder_belongs_to_its_settings(tmp_path):
    resume.open_run(str(tmp_path / "run"), {"m": 1})
    resume.open_run(str(tmp_path / "run"), {"m": 1})
    with pytest.raises(ValueError, match="other settings"):
        resume.open_run(str(tmp_path / "run"), {"m": 2})
    (tmp_path / "other").mkdir()
    resume.open_run(str(tmp_path / "other"), {"m": 1})
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("")
    with pytest.raises(ValueError, match="without a manifest"):
        resume.open_run(str(tmp_path / "full"), {"m": 1})


def made_snapshot(folder, n=3):
    folder.mkdir(parents=True)
    ids = [f"CASE-{k:04d}" for k in range(1, n + 1)]
    for k, i in enumerate(ids):
        (folder / f"{i}.json").write_text(json.dumps({"case_id": i, "target": k % 2 == 0, "model_name": "m-8b", "selection_group": "paired", "steps": []}))
    (folder / f"selected_{n}.jsonl").write_text("\n".join(json.dumps({"case_id": i}) for i in ids) + "\n")
    (folder / "manifest.csv").write_text("selection_id,source_file,source_row\n" + "".join(f"{i},a.jsonl,{k}\n" for k, i in enumerate(ids)))
    (folder / "selection_summary.json").write_text(json.dumps({"seed": 7, "selected_count": n, "target_counts": {"true": 2, "false": 1}, "model_counts": {"m-8b": n}, "selection_group_counts": {"paired": n}}))


def test_import_of_a_snapshot(spark, tmp_path):
    made_snapshot(tmp_path / "data/sel")
    (tmp_path / "data/raw").mkdir()
    run = lambda samples=("CASE-0002",): snapshot.import_snapshot(spark, str(tmp_path / "data"), "sel", "raw", str(tmp_path / "out"), samples, 3, "sel", "1")
    with pytest.raises(ValueError, match="no shards"):
        run()
    assert not (tmp_path / "out").exists()
    (tmp_path / "data/raw/a.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="no such sample: CASE-0009"):
        run(["CASE-0009"])
    got = run()
    manifest = json.loads((tmp_path / "out/dataset_manifest.json").read_text())
    assert (got["sample_count"], got["raw_shard_count"]) == (1, 1) and manifest["metadata"]["seed"] == 7
    assert [f["path"] for f in manifest["files"]] == ["raw/a.jsonl", "sel/manifest.csv", "sel/selected_3.jsonl", "sel/selection_summary.json"]
    assert [c["path"] for c in manifest["metadata"]["copies"]] == ["manifest.csv", "samples/CASE-0002.json", "selection_summary.json"]
    assert (tmp_path / "out/samples/CASE-0002.json").read_bytes() == (tmp_path / "data/sel/CASE-0002.json").read_bytes()
    (tmp_path / "data/sel/manifest.csv").write_text("selection_id\nCASE-0001\nCASE-0002\nCASE-0002\n")
    with pytest.raises(ValueError, match="snapshot: unique ids of the manifest: CASE-0002"):
        run()
    (tmp_path / "data/sel/manifest.csv").unlink()
    with pytest.raises(FileNotFoundError):
        run()
