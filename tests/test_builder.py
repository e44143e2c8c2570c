"""The corpus builder, its command lines, replayed scans and checkpoints: against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.cli import main, round_trip
from quern.operators import builder, tokens
from quern.sources import catalog, checkpoints, jsonl

LENGTH, VOCAB = 40, 300


def raw(seed=3, n=40):
    """Raw records of each stream, with passages that several of them share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    shared = [" ".join(word() for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    text = lambda: rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randrange(1, 80)))
    made = {}
    for stream in dict.fromkeys(s.read_from for s in catalog.SOURCES):
        made[stream] = [{"text": text(), "problem": text(), "solution": text(), "lang": "py", "conversations": [{"value": text()}, {"value": ""}]} for _ in range(n)]
    return made


def extracted(r, fmt):
    solved = f"Problem: {r['problem']}\n\nSolution:\n{r['solution']}"
    return {"text": r["text"], "conversations": r["conversations"][0]["value"], "magicoder": "# py\n" + solved}.get(fmt, solved)


def plain(made, n):
    """name -> [(ord, window, input_ids)], one record after the other."""
    targets, seen, out, done = catalog.group_targets(n), set(), {}, {}
    for s in catalog.SOURCES:
        left = targets[s.group] - done.get(s.group, 0)
        if left <= 0:
            continue
        target, told = catalog.source_target(s, n, left), []
        texts = [(i, extracted(r, s.fmt)) for i, r in enumerate(made[s.read_from])][catalog.source_skip(s, n) :]
        texts = [(i, t) for i, t in texts if len(t) >= 50][: catalog.text_bound(s, target)]
        for i, t in texts:
            ids = [ord(c) for c in t]
            for w, at in enumerate(range(0, len(ids), LENGTH - 2)):
                body = ids[at : at + LENGTH - 2]
                row = [2, *body] + [0] * (LENGTH - 1 - len(body))
                if len(body) >= 15 and len(told) < target and tuple(row[:64]) not in seen:
                    seen.add(tuple(row[:64]))
                    told.append((i, w, row))
        out[s.name] = told
        done[s.group] = done.get(s.group, 0) + len(told)
    return out


def frames(spark, made):
    rows = {}
    for stream, records in made.items():
        data = [(i, r["text"], r["problem"], r["solution"], r["lang"], [tuple(t.values()) for t in r["conversations"]]) for i, r in enumerate(records)]
        rows[stream] = spark.createDataFrame(data, "ord long, text string, problem string, solution string, lang string, conversations array<struct<value:string>>")
        turns = F.transform("conversations", lambda t: F.struct(t["value"].alias("value"), F.lit("").alias("content")))
        rows[stream] = rows[stream].withColumn("conversations", turns).repartition(2)
    return rows


def by_code(texts):
    return texts.withColumn("ids", F.transform(F.split("txt", ""), lambda c: F.ascii(c))).drop("txt")


@pytest.mark.parametrize("n", [30, 120, 5_000])
def test_build_equals_one_record_after_the_other(spark, n):
    made = raw()
    want = plain(made, n)
    built = builder.build(frames(spark, made), by_code, n, VOCAB, LENGTH, 1)
    rows = built.records.collect()
    got = {name: sorted((r["k"], r["ord"], r["window"], r["input_ids"]) for r in rows if r["name"] == name) for name in want}
    assert {k: [x[1:] for x in v] for k, v in got.items()} == want and len(rows) == sum(map(len, want.values()))
    assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
    for name in want:
        assert [r["k"] for r in rows if r["name"] == name] == [*range(len(want[name]))]
    told = {r["name"]: (r["n_records"], r["n_tokens"]) for r in built.stats.collect()}
    assert told == {k: (len(v), sum(sum(x != 0 for x in ids) for _, _, ids in v)) for k, v in want.items() if v}
    total = sum(map(len, want.values()))
    assert built.totals().first()["n_records"] == total
    groups = {r["source"]: r["n_records"] for r in built.by_group().collect()}
    assert sum(groups.values()) == total and set(groups) == set(catalog.GROUPS)


def test_sorted_by_difficulty_and_checked(spark):
    rows = builder.build(frames(spark, raw(n=8)), by_code, 50, VOCAB, LENGTH, 1, sort=True).records.collect()
    assert [r["difficulty"] for r in rows] == sorted(r["difficulty"] for r in rows)
    with pytest.raises(ValueError, match="without records"):
        builder.build({"finemath": spark.createDataFrame([(0, "x")], "ord int, text string")}, by_code, 50, VOCAB, LENGTH, 1)
    bad = spark.createDataFrame([([2, 999], [999, 3], 1.0, "code"), ([2, 5], [5, 3], 1.0, "web")], "input_ids array<int>, labels array<int>, trust_score double, source string")
    assert {r["problem"] for r in builder.flaws(bad, 50, 2).collect()} == {"input id out of range", "group"}
    assert builder.missing_tags(bad.withColumn("o", F.lit(1)), ["o"]).first()["missing"] == "educational,math,reasoning"


def test_windows_are_written_without_labels_and_get_them_back(spark, monkeypatch):
    seen, save = {}, builder.Scratch.save
    monkeypatch.setattr(builder.Scratch, "save", lambda self, df, name: seen.update({name: df.columns}) or save(self, df, name))
    streams = {s.read_from for s in catalog.SOURCES}
    sources = tuple(s for s in catalog.SOURCES if s.fmt == "text")
    made = frames(spark, {k: v[:8] for k, v in raw().items() if k in streams})
    built = builder.build(made, lambda d: d.withColumn("ids", F.transform(F.split("txt", ""), lambda c: F.ascii(c))).drop("txt"), 60, VOCAB, LENGTH, 42, sources=sources)
    got = built.records.select("input_ids", "labels").collect()
    assert got and all("labels" not in c for n, c in seen.items() if n.startswith("windows-")) and "windows-finemath" in seen
    for r in got:
        real = [x for x in r["input_ids"][1:] if x]
        assert r["labels"] == [*real, 3] + [-100] * (LENGTH - 1 - len(real))


def test_source_texts_in_order(spark):
    source = catalog.Source("x", "math", 1, "text", 0, 0, min_score=2.0)
    rows = [(i, "t" * (49 + i % 3), None if i == 7 else float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, text string, score double").repartition(4)
    got = [r["ord"] for r in builder.source_texts(df, source, 6, 4).orderBy("ord").collect()]
    assert got == [i for i, t, s in rows[4:] if (s or 0) >= 2 and len(t) >= 50][:6]


def test_command_lines(spark, tmp_path, capsys):
    made = raw(n=12)
    for stream, records in made.items():
        (tmp_path / "raw" / stream).mkdir(parents=True)
        (tmp_path / "raw" / stream / "a.json").write_text("".join(json.dumps(r) + "\n" for r in records))
    tok, out = str(tmp_path / "tok.json"), str(tmp_path / "out")
    args = ["build", "--input", str(tmp_path / "raw"), "--output", out, "--tokenizer", tok, "--vocab-size", "60", "--max-seq-len", "40"]
    assert main([*args, "--verify-only"], spark) == 0
    assert main([*args, "--train-tokenizer", "--n-samples", "0"], spark) == 0
    assert main([*args, "--train-tokenizer", "--n-samples", "40"], spark) == 0
    rows = jsonl.read_strict(spark, out).collect()
    assert 0 < len(rows) <= 40 and all(len(r["input_ids"]) == 40 for r in rows)
    jsonl.check(spark, out)
    assert main([*args, "--n-samples", str(len(rows))], spark) == 0 and "not built again" in capsys.readouterr().out
    few = str(tmp_path / "few")
    assert main(["subset", "--input", out, "--output", few, "--max-records", "5"], spark) == 0
    assert jsonl.read(spark, few).count() == 5
    with pytest.raises(ValueError, match="above 0"):
        main(["subset", "--input", out, "--output", few, "--max-records", "0"], spark)
    with pytest.raises(FileNotFoundError):
        main(["subset", "--input", str(tmp_path / "none"), "--output", few], spark)
    (tmp_path / "corpus.txt").write_text("abab abab\n\nabc\n")
    assert main(["tokenizer", "--train", str(tmp_path / "corpus.txt"), "--output", tok, "--vocab-size", "12", "--test", "abc abab"], spark) == 0
    assert "round trip: ok" in capsys.readouterr().out
    assert main(["tokenizer", "--load", tok, "--test", "abz"], spark) == 0 and "differs from character 2" in capsys.readouterr().out
    assert main(["tokenizer", "--train", str(tmp_path / "none.txt")], spark) == 1


def test_round_trip_names_the_first_difference():
    vocab, merges, _ = tokens.train_bpe({"abab": 3}, 9)
    assert round_trip("abab", vocab, merges)[2] is None and round_trip("abXab", vocab, merges)[2] == 2


def test_flaws_name_their_line(spark, tmp_path):
    good = json.dumps({"input_ids": [1, 2], "labels": [2, 3], "trust_score": 1.0, "source": "a"})
    path = tmp_path / "r.jsonl"
    path.write_text(f"{good}\n\n{good}\n" + "{broken\n" + good + "\n")
    assert jsonl.first_flaw(spark, str(path))[1:] == (4, "broken")
    path.write_text(f"{good}\n{good.replace('[1, 2]', '[1, 2, 3]').replace('[2, 3]', '[2, 3, 4]')}\n")
    assert jsonl.first_flaw(spark, str(path))[1:] == (2, "length")
    path.write_text(f"{good}\n\n{good}\n")
    assert jsonl.first_flaw(spark, str(path)) is None
    with pytest.raises(ValueError, match="line 1"):
        path.write_text("[]\n")
        jsonl.check(spark, str(path))


def test_replay_wraps_around(spark):
    df = spark.range(10).withColumnRenamed("id", "o")
    rows = [(r["at"], r["o"]) for r in jsonl.replay(df, "o", 3).orderBy("at").collect()]
    assert rows == [(i, i % 10) for i in range(30)]
    seeded = [r["o"] for r in jsonl.replay(df, "o", 3, 5).orderBy("at").collect()]
    for e in range(3):
        own = seeded[10 * e : 10 * e + 10]
        assert own == [(own[0] + i) % 10 for i in range(10)]
    assert seeded == [r["o"] for r in jsonl.replay(df.repartition(3), "o", 3, 5).orderBy("at").collect()]


def test_checkpoints(spark, tmp_path):
    state = spark.createDataFrame([("w", [1.0]), ("b", [2.0])], "name string, value array<double>")
    path = checkpoints.save({"model": state}, str(tmp_path), 1200)
    checkpoints.save({"model": state}, str(tmp_path), 300)
    assert path.endswith("step_00001200") and checkpoints.steps(spark, str(tmp_path)) == [300, 1200] and checkpoints.steps(spark, str(tmp_path / "no")) == []
    now = spark.createDataFrame([("w", [9.0]), ("new", [5.0])], "name string, value array<double>")
    back, step = checkpoints.load(spark, path, {"model": now, "shadow": now})
    assert step == 1200 and {r["name"]: r["value"] for r in back["model"].collect()} == {"w": [1.0], "new": [5.0]}
    assert back["shadow"] is now
    with pytest.raises(FileNotFoundError):
        checkpoints.load(spark, str(tmp_path / "step_00000001"), {"model": now})


def test_lines_with_other_line_ends_are_sound(spark):
    line = '{"input_ids": [1, 2], "text": "a b\u0085c"}'
    row = jsonl.parse_records(spark.createDataFrame([(line,)], "value string")).first()
    assert row["problem"] is None and row["input_ids"] == [1, 2] and row["trust_score"] == 1.0
