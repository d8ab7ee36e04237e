import json
from datetime import datetime as dt

from clausework.operators import schema_drift as sd

SCHEMA = "file_name string, site string, table_name string, exported_at timestamp, line_no int, record string, field string"


def lines(spark, files):
    out = []
    for name, day, records in files:
        out += [(name, "s", "feedback", dt(2024, 1, day), i, r if isinstance(r, str | None) else json.dumps(r), "clash") for i, r in enumerate(records)]
    return spark.createDataFrame(out, SCHEMA)


def log(spark, files):
    return {(r.file_name, r.field, r.change) for r in sd.drift_report(lines(spark, files)).collect()}


def record(i, **more):
    return {"id": i, "kind": ["up", "down", "none"][i % 3], **more}


def test_changes(spark):
    files = [
        ("c", 1, [record(i, n=i) for i in range(20)]),
        ("b", 2, [record(i, n=float(i)) for i in range(30)] + ['{"id": 3, "kind', None, "5"]),
        ("a", 3, [{"id": i, "Kind": ["up", "down", "none"][i % 3], "extra": None} for i in range(25)]),
    ]
    assert log(spark, files) == {("b", "n", "type_changed"), ("a", "kind", "renamed"), ("a", "n", "removed"), ("a", "extra", "added")}


def test_rename_needs_the_content(spark):
    a = [{"id": i, "mark": ["red", "green"][i % 2]} for i in range(20)]
    b = [{"id": i, "speed": 1000 + 37 * i} for i in range(20)]
    assert log(spark, [("1", 1, a), ("2", 2, b)]) == {("2", "mark", "removed"), ("2", "speed", "added")}


def test_types_are_kept_through_a_file_without_values(spark):
    a, none, b = [{"x": 1}] * 9, [{"x": None}] * 9, [{"x": "1"}] * 9
    assert log(spark, [("1", 1, a), ("2", 2, none), ("3", 3, a)]) == set()
    assert log(spark, [("1", 1, a), ("2", 2, none), ("3", 3, b)]) == {("3", "x", "type_changed")}


def test_repeated_lines_and_empty_table(spark):
    a = [record(i) for i in range(10)]
    assert log(spark, [("1", 1, a + a), ("2", 2, a)]) == set()
    assert sd.drift_report(lines(spark, [])).count() == 0


def test_union_schema_and_records(spark):
    files = [("1", 1, [record(i, n=i) for i in range(20)]), ("2", 2, [{"id": i, "Kind": ["up", "down", "none"][i % 3], "n": i + 0.5} for i in range(30)])]
    drift = sd.Drift(lines(spark, files))
    names = sd.canonical_names(drift)
    assert {(r.field, r.column) for r in names.collect()} == {("id", "id"), ("kind", "Kind"), ("Kind", "Kind"), ("n", "n")}
    types = {r.column: r.union_type for r in sd.union_schema(drift, names).collect()}
    assert types == {"id": "whole", "Kind": "string", "n": "decimal"}
    whole = sd.unified_table(drift.lines, "feedback", sd.unified_columns(drift)["feedback"])
    assert dict(whole.dtypes) | {"id": "bigint", "Kind": "string", "n": "double"} == dict(whole.dtypes)
    assert whole.count() == whole.where("Kind is not null and n is not null").count() == 50


def test_every_shape_of_a_key_is_cast_to_one_type(spark):
    shapes = [lambda i: i, lambda i: [i], lambda i: {"id": i}, lambda i: f"CHK-{i:08d}", str, float]
    files = [(f"f{k}", k + 1, [{"key": shape(100 + i), "flag": [1, True, "no"][k % 3], "mark": [["a"], ["b"]][i % 2]} for i in range(12)]) for k, shape in enumerate(shapes)]
    drift = sd.Drift(lines(spark, files))
    whole = sd.unified_table(drift.lines, "feedback", sd.unified_columns(drift)["feedback"])
    assert [whole.schema[c].dataType.simpleString() for c in ("key", "flag", "mark")] == ["bigint", "bigint", "array<string>"]
    assert sorted(r.key for r in whole.collect()) == sorted([100 + i for i in range(12)] * 6)
    texts = sd.Drift(lines(spark, [("1", 1, [{"code": f"AB-{i}", "zip": f"0{i}"} for i in range(9)])]))
    assert {c: t for c, t, _ in sd.unified_columns(texts)["feedback"]} == {"code": "string", "zip": "string"}


def test_clashing_column_and_null_keys(spark):
    rows = lines(spark, [("1", 1, [{"site": i, "x": None} for i in range(5)]), (None, 1, [{"site": 1}])])
    drift = sd.Drift(rows)
    whole = sd.unified_table(rows, "feedback", sd.unified_columns(drift)["feedback"])
    assert sorted(r.record_site for r in whole.collect()) == [0, 1, 2, 3, 4]


def test_fold_over_partitions_is_the_fold_over_all_files(spark):
    import random

    random.seed(4)
    files, rows = [], []
    names = ["a", "b", "c", "d", "e"]
    for n in range(60):
        have = random.sample(names, random.randint(1, 4))
        value = {x: random.choice([None, n, float(n) + 0.5, "t"]) for x in have}
        files.append((n, value))
        rows.append((f"f{n:03d}", 1 + n % 28, [value]))
    ordered = sorted(zip([(d, f) for f, d, _ in rows], [v for _, v in files], strict=True))
    want, state = set(), None
    for (_, name), value in ordered:
        kinds = {x: {int: "whole", float: "decimal", str: "string"}.get(type(v)) for x, v in value.items()}
        if state is not None:
            want |= {(name, x, "added") for x in kinds.keys() - state.keys()} | {(name, x, "removed") for x in state.keys() - kinds.keys()}
            want |= {(name, x, "type_changed") for x in kinds.keys() & state.keys() if kinds[x] and state[x] and kinds[x] != state[x]}
        state = {x: k or (state or {}).get(x) for x, k in kinds.items()}
    drift = sd.Drift(lines(spark, rows))
    none = drift.renames.limit(0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered_files = sd.file_headers(drift.counts)
        assert ordered_files.select("block").distinct().count() >= 3
        got = {(r.file_name, r.field, r.change) for r in sd.schema_changes(ordered_files, none).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want and len(want) > 50


def test_a_file_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "FILE_BLOCK", 7)
    a, b = [record(i, n=i) for i in range(100)], [{"id": i, "Kind": ["up", "down", "none"][i % 3], "n": i} for i in range(100)]
    assert log(spark, [("1", 1, a), ("2", 2, b)]) == {("2", "kind", "renamed")}


def test_every_gone_field_gets_the_best_free_one(spark):
    a = [{"id": i, "qqq": 100 + i, "www": 500 + i} for i in range(20)]
    b = [{"id": i, "kkk": 200 + i, "zzz": 700 + i} for i in range(20)]
    assert log(spark, [("1", 1, a), ("2", 2, b)]) == {("2", "qqq", "renamed"), ("2", "www", "renamed")}
