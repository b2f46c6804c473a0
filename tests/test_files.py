"""Committed sinks and sources by stretches of files."""

from __future__ import annotations

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aurigraph.sources import committed, ranges, records, shared, wav
from aurigraph.streaming import events


def lines(spark, n: int, output: str = "a"):
    return spark.range(n).repartition(4).select(F.lit(output).alias("output"), F.format_string("line %d", "id").alias("line"))


def seen(spark, path: str, **of) -> list[tuple]:
    return sorted((r.output, r.line) for r in committed.read(spark, path, **of).collect())


def test_a_job_commits_once(spark, tmp_path):
    out = str(tmp_path / "o")
    assert seen(spark, out) == [] and committed.manifest(out)["version"] == 0
    both = lines(spark, 100).unionByName(lines(spark, 7, "b"))
    for _ in range(2):
        committed.write(both, out, "one")
        assert len(seen(spark, out)) == 107 and committed.manifest(out)["version"] == 1
    committed.write(lines(spark, 5, "b"), out, "two")
    assert len(seen(spark, out)) == 112 and len(seen(spark, out, version=1)) == 107
    assert committed.read(spark, out).filter("output = 'b'").count() == 12
    assert sum(f["rows"] for f in committed.manifest(out)["files"]) == 112
    committed.write(lines(spark, 3, "b"), out, "three", overwrite=True)
    assert seen(spark, out) == [("b", f"line {i}") for i in range(3)] and spark.read.text(f"{out}/b").count() == 3


def test_failed_and_late_writers_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "o")
    committed.write(lines(spark, 10), out, "one")
    broken = lines(spark, 50).withColumn("line", F.when(F.col("line") == "line 33", F.lit("two\nlines")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="line break"):
        committed.write(broken, out, "two")
    assert len(seen(spark, out)) == 10 and not list((tmp_path / "o" / "_staging").iterdir())
    committed.write(lines(spark, 4), out, "two", expect=1)
    with pytest.raises(Exception, match="published after"):
        committed.write(lines(spark, 4), out, "three", expect=1)
    assert len(seen(spark, out)) == 14 and spark.read.text(f"{out}/a").count() == 14


def test_a_rerun_sweeps_what_a_killed_commit_had_moved(spark, tmp_path):
    out = tmp_path / "o"
    (out / "a").mkdir(parents=True)
    (out / "a" / "part-000099-one.jsonl").write_text("moved but never published\n")
    (out / "a" / "part-000000-one.jsonl").write_text("moved but never published\n")
    committed.write(lines(spark, 10), str(out), "one")
    assert len(seen(spark, str(out))) == 10 and spark.read.text(str(out / "a")).count() == 10


def test_two_publishers_of_one_version(tmp_path):
    where, root = shared.store(str(tmp_path / "o"))
    state = {"version": 1, "jobs": ["x"], "files": []}
    assert committed._publish(where, root, state) and not committed._publish(where, root, state | {"jobs": ["y"]})
    assert committed.manifest(str(tmp_path / "o"))["jobs"] == ["x"]


def test_a_benchmark_commits_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "bench")
    items = spark.range(40).select(F.format_string("i%02d", "id").alias("item_id"), F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"), F.col("id").cast("double").alias("azimuth"))
    rejected = spark.createDataFrame([("x", ["quiet"])], "render string, failures array<string>")
    for _ in range(2):
        records.write_benchmark(items, rejected, out, ["item_id"], ["item_id", "azimuth"], job="v1")
        counts = {r["output"]: r["count"] for r in committed.read(spark, out).groupBy("output").count().collect()}
        assert counts == {"train": 14, "dev": 13, "test_public": 13, "test_private_labels": 13, "rejected_items": 1}
    told = [json.loads(x) for p in sorted((tmp_path / "bench" / "train").glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["item_id"] for r in told] == sorted(r["item_id"] for r in told)
    assert len({f["file"].rsplit("-", 1)[1] for f in committed.manifest(out)["files"]}) == 1


def test_a_second_collector_is_turned_away(spark, tmp_path):
    items = spark.range(6).select(F.col("id").alias("item_id"))
    folder = str(tmp_path / "answers")

    def slow(todo):
        events.collect_missing(items.limit(2), folder, lambda t: t.withColumn("answer", F.lit("first")))
        return todo.withColumn("answer", F.lit("second"))

    with pytest.raises(Exception, match="published after"):
        events.collect_missing(items, folder, slow)
    assert spark.read.schema("item_id long, answer string").json(folder).count() == 2
    assert events.collect_missing(items, folder, lambda t: t.withColumn("answer", F.lit("third"))) == 4


class Counted(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        data = super().read(n)
        self.bytes_read += len(data)
        return data


def test_an_excerpt_reads_its_own_bytes():
    content = wav.encode([np.sin(np.arange(480_000) / 50)], 48_000)
    file = Counted(content)
    part = wav.read_at(file, 4.0, 0.01, 48_000)
    assert part == pytest.approx(np.sin(np.arange(192_000, 192_480) / 50), abs=1e-4)
    assert file.bytes_read < 480 * 2 + 200


def test_excerpts_move_plans_only(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s {k}.wav").write_bytes(wav.encode([np.full(4800, k / 4)], 48_000))
    plans = spark.createDataFrame([(i, f"s {i % 3}", 0.01 * (i % 5), 0.02) for i in range(40)], "id int, stem string, start_s double, duration_s double").repartition(5)
    found = wav.excerpts(spark, plans, str(tmp_path), 48_000, ["id", "stem"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "content" not in plan
    rows = found.collect()
    assert len(rows) == 40 and all(len(r.mono) == 960 and r.mono[5] == pytest.approx(int(r.stem[2:]) / 4, abs=1e-4) for r in rows)


def test_frames_by_stretch(spark, tmp_path):
    signals = {f"{k}.wav": np.random.default_rng(k).uniform(-1, 1, (1000 + k, 2)) for k in range(2)}
    for name, x in signals.items():
        (tmp_path / name).write_bytes(wav.encode(list(x.T), 8000, 24))
    for stretch in (600, 997, 1 << 20):
        rows = ranges.frames(spark, str(tmp_path), stretch).orderBy("path", "start").collect()
        for name, x in signals.items():
            own = [r for r in rows if r.path.endswith(name)]
            got = np.concatenate([r.samples for r in own]).reshape(-1, 2)
            assert got == pytest.approx(x, abs=1e-6) and [r.start for r in own] == [0, *np.cumsum([len(r.samples) // 2 for r in own])[:-1]]
    path = str(tmp_path / "1.wav")
    part = ranges.frames(spark, str(tmp_path), 600).filter((F.col("path") == path) & (F.col("start") >= 300) & (F.col("start") < 500))
    assert {r.path for r in part.collect()} == {path} and all(300 <= r.start < 500 for r in part.collect())
    reader = ranges.FramesReader({"path": str(tmp_path), "stretch": "600"})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("path",), path)])) == [] and {s.path for p in reader.partitions() for s in p.stretches} == {path}


def test_lines_by_stretch(spark, tmp_path):
    texts = ["", "a", "", "bé" * 40, "x" * 300, "", "last without end"]
    (tmp_path / "t.txt").write_bytes("\n".join(texts).encode())
    (tmp_path / "u.txt").write_bytes(b"\n\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    starts = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])[:-1].tolist()
    for stretch in (1, 2, 7, 64, 1 << 20):
        got = [(r.path.rsplit("/", 1)[1], r.offset, r.line) for r in ranges.lines(spark, str(tmp_path), stretch).collect()]
        assert sorted(got) == sorted([("t.txt", o, t) for o, t in zip(starts, texts, strict=True)] + [("u.txt", 0, ""), ("u.txt", 1, "")])


def test_unknown_stems_are_errors(spark):
    from aurigraph.operators import plan as P

    stems = spark.createDataFrame([("AuSep_1_vc_07_Piece",), ("odd",), ("AuSep_2_zz_07_Piece",)], "stem string")
    for bad, said in (("odd", "no name of a stem: odd"), ("AuSep_2_zz_07_Piece", "no instrument has the code zz")):
        with pytest.raises(Exception, match=said):
            P.parse_stems(stems.filter(F.col("stem").isin("AuSep_1_vc_07_Piece", bad)), "stem").collect()
    assert [(r.stem, r.instrument) for r in P.parse_stems(stems, "stem", strict=False).orderBy("stem").collect()] == [("AuSep_1_vc_07_Piece", "cello"), ("AuSep_2_zz_07_Piece", None)]


def test_training_examples_are_packed(spark, tmp_path, monkeypatch):
    """What repeats in prompts is not stored again for each item; files stay small enough for a task, and all lines read back."""
    monkeypatch.setattr(records, "EXAMPLES", 800)
    law = "A law that every prompt states. " * 20
    made = spark.range(0, 4000, 1, 2).select(F.col("id").alias("item_id"), F.lit("a.wav").alias("audio_path"), F.concat(F.lit(law), F.col("id")).alias("prompt"), F.lit("t\nü").alias("target"), F.lit("cues").alias("condition"))
    path = tmp_path / "sft"
    records.write_examples(made, str(path), packed=True)
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert len(files) == 6 and sum(f.stat().st_size for f in files) < 4000 * len(law) / 10
    back = spark.read.schema(made.schema).json(str(path))
    assert back.count() == 4000 and back.exceptAll(made).isEmpty()
