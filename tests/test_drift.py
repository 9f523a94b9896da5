import json
import random

from ledgerloom.operators import drift

SCHEMA = "line_id bigint, pipeline_id bigint, file_name string, raw string, stage string"


def compare(old, seen, new):
    """The changes from one record's tagged paths to the next one's, by the rule."""
    kind = lambda p: old[p] or seen.get(p, "")
    agree = lambda a, b: not kind(a) or not new[b] or kind(a) == new[b]
    gone, come, out = sorted(set(old) - set(new)), sorted(set(new) - set(old)), set()
    for a in list(gone):
        match = [b for b in come if a.split(".")[-1] == b.split(".")[-1] and agree(a, b)]
        if match:
            gone.remove(a)
            come.remove(match[0])
            out.add(("renamed", a, match[0]))
    if len(gone) == len(come) == 1 and agree(gone[0], come[0]):
        out.add(("renamed", gone.pop(), come.pop()))
    out |= {("removed", a, "") for a in gone} | {("added", "", b) for b in come}
    return out | {("type_changed", p, p) for p, t in new.items() if t and p in old and seen.get(p, t) != t}


def sequential(rows):
    """The rule, one record after the other, without unions."""
    streams, out = {}, set()
    ordered = sorted((r for r in rows if r[1] is not None and drift._STAMP.search(r[2] or "")), key=lambda r: (drift._STAMP.search(r[2])[1], r[2], r[0]))
    for _, pid, file, raw, _ in ordered:
        got = drift.parse(raw)
        if not got:
            continue
        stage, new = got[0], json.loads(got[1])
        before, old, seen = streams.get((pid, stage), (None, None, {}))
        if before == file:
            continue
        for what, a, b in compare(old, seen, new) if old is not None else ():
            out.add((pid, file, stage, what, a, b))
            if what == "renamed" and a in seen:
                seen[b] = seen[a]
        streams[pid, stage] = (file, new, seen | {p: t for p, t in new.items() if t})
    return out


def record(stage, **metadata):
    return json.dumps({"stage": stage, "items": 1, "metadata": metadata})


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r)[:6] for r in drift.schema_changes(df).collect()}


def test_each_kind_of_change(spark):
    f = lambda i: f"ABC_2024010{i}_120000.json"
    rows = [
        (1, 1, f(1), record("a", x=1, y=True), "z"), (2, 1, f(2), record("a", x=None, y=True), "z"), (3, 1, f(3), record("a", x="7", y=True), "z"),
        (4, 1, f(4), record("a", n=True, x="7"), "z"), (5, 1, f(5), record("a", n=True, x="7", more=[1]), "z"), (6, 1, f(6), record("a", n=True, x="7"), "z"),
        (7, 1, f(7), '{"stage": "a", ', "z"), (8, 1, f(8), record("a", deep={"n": True, "x": "7"}), "z"), (9, 1, f(8), record("a", deep={"x": "7", "n": True}), "z"),
        (10, 1, f(1), record("b", q=1), "z"), (11, 2, f(2), record("a", q=1), "z"), (12, 1, f(9), None, "z"), (13, None, f(9), record("a"), "z"), (14, 1, "no time", record("a"), "z"), (15, 1, f(9), "[1]", "z"), (16, 1, f(9), "", "z"),
    ]
    assert found(spark, rows) == {
        (1, f(3), "a", "type_changed", "metadata.x", "metadata.x"), (1, f(4), "a", "renamed", "metadata.y", "metadata.n"), (1, f(5), "a", "added", "", "metadata.more"), (1, f(6), "a", "removed", "metadata.more", ""),
        (1, f(8), "a", "renamed", "metadata.n", "metadata.deep.n"), (1, f(8), "a", "renamed", "metadata.x", "metadata.deep.x"),
    }
    assert found(spark, rows) == found(spark, rows[::-1])


def test_a_long_stream_over_many_partitions(spark):
    rng, rows, names = random.Random(8), [], ["p", "q", "r", "s"]
    for i in range(900):
        pid = 1 if rng.random() < 0.7 else rng.randrange(2, 6)  # one hot pipeline
        m = {n: rng.choice([1, "x", None, True]) for n in names if rng.random() < 0.97}
        rows.append((i, pid, f"T_{20240101 + i % 27}_{i:06d}.json", record("only", **m), "z"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == sequential(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_unions_fuse_as_they_grow():
    rng, names = random.Random(3), ["p", "q", "r", "a.p", "b.q"]
    kinds = ["number", "string", ""]
    for _ in range(300):
        texts = [json.dumps({n: rng.choice(kinds) for n in sorted(names) if rng.random() < 0.7}) for _ in range(rng.randrange(2, 9))]
        whole, parts, cut = drift.Union(), [drift.Union(), drift.Union()], rng.randrange(1, len(texts))
        for i, t in enumerate(texts):
            whole.take("k", f"f{i}", t)
            parts[i >= cut].take("k", f"f{i}", t)
        fused, more = parts[0].fuse(parts[1]), json.dumps({"p": "number", "q": "string", "x": "array"})
        assert sorted(fused.take("k", "z", more)) == sorted(whole.take("k", "z", more))


def test_more_paths_than_columns(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_PATHS", 3)
    rows = [(i, 1, f"A_2024010{i}_000000.json", record("a", **{f"id{i}": i, "x": i}), "z") for i in range(1, 5)]
    t = drift.consistent_table(spark.createDataFrame(rows, SCHEMA))
    got = {r["file_name"]: r for r in t.collect()}
    assert got["A_20240102_000000.json"]["~rest"] == {"metadata.id2": "2"} and got["A_20240102_000000.json"]["metadata.x"] == 2.0


def test_one_table_of_all_records(spark):
    rows = [(1, 1, "A_20240101_000000.json", record("a", x=1, Y=1), "z"), (2, 1, "A_20240102_000000.json", record("a", x="seven", y=[1, 2]), "z"), (3, 1, "A_20240103_000000.json", record("a", x=2.5), "z"), (4, 1, "A_20240104_000000.json", record("a", x=1) + " trailing", "z")]
    t = drift.consistent_table(spark.createDataFrame(rows, SCHEMA))
    got = {r["file_name"]: r for r in t.collect()}
    assert len(got) == 3
    assert got["A_20240101_000000.json"]["metadata.x"] == 1.0 and got["A_20240102_000000.json"]["metadata.x"] is None
    assert got["A_20240102_000000.json"]["metadata.x::string"] == "seven" and got["A_20240103_000000.json"]["metadata.x::number"] == 2.5
    assert {c for c in t.columns if c.lower().startswith("metadata.y")} == {"metadata.Y", "metadata.y~"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(df).count() == 0 and drift.fused_schema(df).count() == 0 and drift.consistent_table(df).count() == 0
