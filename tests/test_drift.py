import json
import random
from datetime import datetime, timedelta

import pytest

from ionloom.operators import drift

SCHEMA = "exporter string, file string, at timestamp, line bigint, payload string"
T0 = datetime(2025, 1, 1)


def lines(files):
    out, n = [], 0
    for k, (name, records) in enumerate(files):
        for r in records:
            out.append(("x", name, T0 + timedelta(days=k), n, r if isinstance(r, str) or r is None else json.dumps(r)))
            n += 1
    return out


def changes(spark, rows, target={}):
    df = spark.createDataFrame(rows, SCHEMA)
    out = drift.changes(drift.ingest(df, "payload", target), ["exporter"], "file", "at", "id", ["line"])
    return {(r["file"], r["prev_name"], r["new_name"], r["change_kind"]) for r in out.collect()}


FILES = [
    ("f3", [{"id": 1, "rt": 1.5, "s": "a", "gone": 1}, {"id": 2, "rt": 2.5, "s": None, "gone": 2}, '{"id": 3, "rt"', "[1]", None, ""]),
    ("f1", [{"id": 1, "RT": 1.5, "s": None}, {"id": 2, "RT": 2.5, "s": None, "new": 7}, {"id": 9, "RT": 0}, {"id": 1, "RT": 1.5, "s": None}]),
    ("f2", [{"id": 1, "RT": "1.5", "s": 3, "new": 7.5}, {"id": 2, "RT": "2.5", "new": None}]),
    ("f0", [{"id": 1, "elution": "1.5", "s": 3, "new": [1]}, {"id": 4, "elution": "9"}]),
    ("f9", [{"id": 1, "elution": 1.5, "s": 3, "new": {"v": 1}}]),
]
WANTED = {
    ("f1", "rt", "RT", "renamed"), ("f1", "gone", "", "removed"), ("f1", "", "new", "added"),
    ("f2", "RT", "RT", "type_changed"), ("f2", "s", "s", "type_changed"),
    ("f0", "RT", "elution", "renamed"), ("f0", "new", "new", "type_changed"),
    ("f9", "elution", "elution", "type_changed"), ("f9", "new", "new", "type_changed"),
}


@pytest.mark.parametrize("target", [{}, {"id": "bigint", "rt": "double", "s": "string", "gone": "int"}])
def test_added_removed_renamed_and_changed(spark, target):
    """What is typed and what is rescued makes no difference to what is reported."""
    assert changes(spark, lines(FILES), target) == WANTED


def test_kind_is_remembered_over_files_and_blocks(spark):
    files = [("a", [{"id": 1, "f": 1}]), ("b", [{"id": 1, "f": None}]), ("c", [{"id": 1, "f": None}]), ("d", [{"id": 1, "f": "x"}])]
    assert changes(spark, lines(files)) == {("d", "f", "f", "type_changed")}


def test_one_disagreeing_record_is_no_rename(spark):
    files = [("a", [{"id": i, "p": i} for i in range(5)]), ("b", [{"id": i, "q": i if i < 4 else 99} for i in range(5)])]
    assert changes(spark, lines(files)) == {("b", "p", "", "removed"), ("b", "", "q", "added")}


def told_in_turn(files):
    """Changes of a series read file by file, in plain Python."""
    out, state, prev = set(), {}, None
    for name, records in files:
        names = {n for r in records for n in r}
        if prev is not None:
            lost, gained = sorted(set(prev[0]) - names), sorted(names - set(prev[0]))
            by_id = lambda rs: {r["id"]: r for r in rs if r.get("id") is not None}
            one, two = by_id(prev[1]), by_id(records)
            moved, taken = [], set()
            for a in lost:
                for b in gained:
                    pairs = [(one[i].get(a), two[i].get(b)) for i in one.keys() & two.keys()]
                    if b not in taken and all(drift.canonical(x) == drift.canonical(y) for x, y in pairs) and any(x is not None for x, _ in pairs):
                        moved.append((a, b))
                        taken.add(b)
                        break
            olds = {a for a, _ in moved}
            out |= {(name, a, b, "renamed") for a, b in moved} | {(name, a, "", "removed") for a in lost if a not in olds} | {(name, "", b, "added") for b in gained if b not in taken}
        kinds = {n: {drift.kind_of(r[n]) for r in records if r.get(n) is not None} for n in names}
        if prev is not None:
            out |= {(name, n, n, "type_changed") for n in names & set(prev[0]) if state.get(n) and kinds[n] - state[n]}
            moves = {b: state.pop(a, None) for a, b in moved}
            state.update(moves)
        state.update({n: k for n, k in kinds.items() if k})
        prev = (names, records)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_long_series_of_renames_equals_reading_in_turn(spark, seed):
    r = random.Random(seed)
    files, names = [], {"a": ("num", 1), "b": ("num", 2), "c": ("text", 3), "d": ("null", 4)}
    make = {"num": lambda i, k: i * 7 + k, "text": lambda i, k: f"t{i}{k}", "null": lambda i, k: None, "flag": lambda i, k: (i + k) % 2 == 0, "list": lambda i, k: [i, k]}
    for k in range(40):
        for _ in range(r.randrange(3)):
            old = r.choice(sorted(names))
            # Old names come back now and then.
            names[r.choice([n for n in "abcdefghij" if n not in names] or ["zz"])] = names.pop(old)
        if r.random() < 0.4:
            n = r.choice(sorted(names))
            names[n] = (r.choice(sorted(make)), names[n][1])
        files.append((f"f{k:02d}", [{"id": i, **{n: make[v](i, s) for n, (v, s) in names.items() if r.random() < 0.98}} for i in range(r.randrange(1, 5))]))
    assert changes(spark, lines(files)) == told_in_turn(files)


def test_repeated_fields_count_by_their_last_and_broken_lines_are_told(spark):
    rows = [("x", "f", T0, k, p) for k, p in enumerate(['{"a": 1, "a": 2, "b": 3}', "{", "[1]", None, " ", '{"a": NaN}', '{"a": 1} x', '{"a": {"b": 1, "b": 2}}', '{"t": "\\ud800x"}', '{"n": 1e999}'])]
    got = {r["line"]: r for r in drift.ingest(spark.createDataFrame(rows, SCHEMA), "payload", {"a": "int"}).collect()}
    assert [got[k]["_reason"] for k in range(10)] == ["repeated field", "no JSON", "no object", "empty", "empty", "no JSON", "no JSON", None, None, None]
    assert got[0]["a"] == 2 and [x["name"] for x in got[0]["_seen"]] == ["a", "b"] and json.loads(got[7]["_rescued"]) == {"a": {"b": 2}}
    # A field that only such a line names is in the file.
    more = [("x", "e", T0 - timedelta(days=1), 99, '{"a": 1}'), *rows[:1]]
    assert ("f", "", "b", "added") in changes(spark, more)


def test_every_line_is_held_against_its_own_table(spark):
    rows = [(1, "t1", '{"a": 1, "b": "x"}'), (2, "t2", '{"a": 1, "b": "x"}'), (3, "other", '{"a": null}'), (4, None, '{"a": 2}')]
    df = spark.createDataFrame(rows, "k int, tab string, payload string")
    got = {r["k"]: {x["name"]: x["place"] for x in r["_seen"]} for r in drift.ingest(df, "payload", {"t1": {"a": "int"}, "t2": {"b": "string"}}, of="tab").collect()}
    assert got == {1: {"a": "typed", "b": "rescued"}, 2: {"a": "rescued", "b": "typed"}, 3: {"a": "null"}, 4: {"a": "rescued"}}


def test_ingest_rescue_and_replay(spark):
    target = {"id": "bigint", "rt": "double", "n": "int", "name": "string"}
    rows = [("a", {"id": 1, "rt": "1.5", "n": 3, "name": "x", "zz": {"q": [1, 2]}}), ("b", {"id": 2, "RT": 2.5, "n": "many", "name": None}), ("c", {"id": 3, "rt": {"value": 7, "origin": "v2"}, "n": [4], "name": 5}), ("d", "not json"), ("e", None)]
    df = spark.createDataFrame([(k, p if isinstance(p, str) or p is None else json.dumps(p)) for k, p in rows], "k string, payload string")
    got = {r["k"]: r for r in drift.ingest(df, "payload", target).collect()}
    # A value of another kind than its column's is kept as it came until it is replayed.
    assert (got["a"]["rt"], got["a"]["n"], json.loads(got["a"]["_rescued"])) == (None, 3, {"rt": "1.5", "zz": {"q": [1, 2]}})
    assert (got["b"]["rt"], got["b"]["n"], json.loads(got["b"]["_rescued"])) == (None, None, {"RT": 2.5, "n": "many"})
    assert got["d"]["_seen"] is None and got["d"]["id"] is None and got["e"]["_rescued"] is None
    first = drift.ingest(df, "payload", target).where("_seen is not null").drop("_seen")
    once = {r["k"]: r for r in drift.replay(first, target).collect()}
    assert once["a"]["rt"] == 1.5 and json.loads(once["a"]["_rescued"]) == {"zz": {"q": [1, 2]}} and once["b"]["rt"] is None
    assert (once["c"]["rt"], once["c"]["n"], once["c"]["name"], once["c"]["_rescued"]) == (7.0, 4, "5", None)
    again = {r["k"]: r for r in drift.replay(drift.replay(first, target), target | {"zz": "string"}, {"RT": "rt"}).collect()}
    assert again["b"]["rt"] == 2.5 and json.loads(again["b"]["_rescued"]) == {"n": "many"}
    assert again["a"]["rt"] == 1.5 and again["a"]["id"] == 1 and again["a"]["zz"] is None
    # A second value for a column that has one stays rescued.
    two = spark.createDataFrame([("x", '{"rt": 1.5, "RT": 9}')], "k string, payload string")
    kept = drift.replay(drift.ingest(two, "payload", target), target, {"RT": "rt"}).first()
    assert kept["rt"] == 1.5 and json.loads(kept["_rescued"]) == {"RT": 9}
    with pytest.raises(ValueError):
        drift.ingest(df.withColumn("rt", df["k"]), "payload", target)


def test_values_read_leniently():
    cases = [("1.5", "double", 1.5), (" 12 ", "int", 12), ("12.0", "int", 12), ("12.5", "int", None), ("1_0", "int", None), ("nan", "double", None), (True, "int", 1), (3.0, "bigint", 3), (3.5, "bigint", None), (2**40, "int", None), (5, "string", "5"), (False, "string", "false"), ([7], "double", 7.0), ([7, 8], "double", None), ({"value": "x"}, "string", "x"), ({"v": 1}, "int", None), ("yes", "boolean", None), ("TRUE", "boolean", True), (1, "boolean", True), (None, "int", None)]
    for value, sql, want in cases:
        got = drift.lenient(value, sql)
        assert got == want and type(got) is type(want), (value, sql, got)


def test_only_renames_that_lead_to_a_column_are_fetched(spark):
    pairs = [("rt", "a"), ("b", "a"), ("b", "c"), *((f"id{k}", f"id{k + 1}") for k in range(0, 50, 2))]
    df = spark.createDataFrame(pairs, "prev_name string, new_name string")
    assert drift.linked(df, ["rt", "score"]) == [("b", "a"), ("b", "c"), ("rt", "a")]


def test_approvals():
    assert drift.approvals([("rt", "elution"), ("elution", "e2"), ("score", "x"), ("x", "rank")], ["rt", "score", "rank"], ["RT", "other"]) == {"elution": "rt", "e2": "rt", "RT": "rt"}


def test_empty(spark):
    assert changes(spark, []) == set()
