import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from spendscope.functions.hashing import HASH_HEX_CHARS
from spendscope.operators import evals, fingerprint
from spendscope.sources import eval_files, request_log

SALT = b"a salt of the tests"


def items_of(spark, put, cases, outputs, name="out"):
    read = lambda path: eval_files.read_eval_lines(spark, path)
    return evals.eval_items(eval_files.cases(read(put("cases.jsonl", cases))), eval_files.outputs(read(put(f"{name}.jsonl", outputs))))


# -- checks ------------------------------------------------------------------------------------------

# One case a row: its checks, the output, and the labels of those that fail.
SCORED = [
    ([{"type": "exact", "value": "Window Seat"}], "  window\tseat\n", []),
    ([{"type": "exact", "value": 17}], "17", []),
    ([{"type": "exact", "value": "aisle"}], "aisle seat", ["exact:aisle"]),
    ([{"value": "gate B4"}], "Go to GATE  b4 now", []),
    ([{"kind": "contains", "value": "gate"}], "no door", ["contains:gate"]),
    ([{"type": "contains_all", "value": ["gate", "b4"]}], "B4 is the gate", []),
    ([{"type": "contains_all", "value": ["gate", "b5"]}], "B4 is the gate", ['contains_all:["gate","b5"]']),
    ([{"type": "one_of", "value": ["yes", "of course"]}], "Of  Course", []),
    ([{"type": "one_of", "value": ["yes", "sure"]}], "yes indeed", ['one_of:["yes","sure"]']),
    ([{"type": "json_field", "field": "seat", "value": "12A"}], '{"seat": "12A", "row": 12}', []),
    ([{"type": "json_field", "field": "row", "value": 12}], '{"seat": "12A", "row": 12}', []),
    ([{"type": "json_field", "field": "row", "value": 13}], '{"row": 12}', ["json_field:row"]),
    ([{"type": "json_field", "field": "seat", "value": "12A"}], "seat 12A", ["json_field:seat"]),
    ([{"type": "json_field", "field": "seat", "value": "12A"}], '["seat", "12A"]', ["json_field:seat"]),
    ([{"value": "seat"}, {"type": "json_field", "field": "row", "value": 12}, {"type": "exact", "value": "x"}], '{"seat": 1, "row": 12}', ["exact:x"]),
    ([], "anything", []),
]


def test_checks(spark, put):
    cases = [{"id": k, "workload": "booking", "checks": c} for k, (c, _, _) in enumerate(SCORED)]
    first = [{"id": k, "output": "overwritten later"} for k in range(len(SCORED))]
    last = [{"id": k, "output": o, "model": "m1"} for k, (_, o, _) in enumerate(SCORED)]
    got = items_of(spark, put, cases, [*first, {"output": "belongs to nothing"}, *last]).orderBy("seq").collect()
    assert [r.failed_checks for r in got] == [labels for _, _, labels in SCORED]
    assert [r.passed for r in got] == [not labels for _, _, labels in SCORED]


def test_json_is_parsed_once_a_row(spark, put):
    frame = items_of(spark, put, [{"id": 1, "checks": SCORED[9][0] * 2}], [{"id": 1, "output": SCORED[9][1]}])
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_cases_without_output_or_checks(spark, put):
    cases = [{"id": "p", "checks": [{"value": "x"}]}, {"id": "q", "workload": "", "checks": None}]
    p, q = items_of(spark, put, cases, [{"id": "q", "output": ""}]).orderBy("seq").collect()
    assert (p.missing, p.passed, p.failed_checks) == (True, False, ["missing output"])
    assert (q.passed, q.workload, q.model) == (True, "all", "")


def test_unknown_checks_and_broken_lines_are_errors(spark, put):
    with pytest.raises(Exception, match="unknown check type"):
        items_of(spark, put, [{"id": 1, "checks": [{"type": "sounds_like", "value": "x"}]}], [{"id": 1, "output": "x"}]).collect()
    with pytest.raises(ValueError, match=r"f/odd.jsonl:3: invalid JSON"):
        eval_files.read_eval_lines(spark, put("f/odd.jsonl", ["{}", "", "{'single': 1}"]))


# -- gate --------------------------------------------------------------------------------------------


def test_gate_on_a_hundred_cases(spark, put):
    """The old model passes 92 of 100 cases, the new one 94: it may lose two percent and gains two."""
    cases = [{"id": k, "workload": f"group {k % 4}", "checks": [{"type": "exact", "value": f"answer {k}"}]} for k in range(100)]
    side = lambda wrong, model: [{"id": k, "output": "?" if k in wrong else f"answer {k}", "model": model} for k in range(100)]
    old = items_of(spark, put, cases, side(set(range(8)), "old"), "old")
    new = items_of(spark, put, cases, side({3, 50, 51, 52, 53, 54}, "new"), "new")
    gate = evals.eval_gate(old, new).first()
    assert (gate.baseline_passed, gate.candidate_passed, gate.gate_pass) == (92, 94, True)
    assert gate.delta == pytest.approx(0.02) and not evals.eval_gate(new, old, tolerance=0.01).first().gate_pass
    lost = evals.eval_regressions(old, new)
    assert [r.id for r in evals.first_regressions(lost, 3).collect()] == ["50", "51", "52"] and lost.count() == 5
    groups = {r.workload: (r.baseline_passed, r.candidate_passed) for r in evals.eval_by_workload(old, new).collect()}
    assert groups == {"group 0": (23, 24), "group 1": (23, 24), "group 2": (23, 22), "group 3": (23, 24)} or sum(b for b, _ in groups.values()) == 92
    assert {(r.side, r.model, r.n) for r in evals.eval_models(old, new).collect()} == {("baseline", "old", 100), ("candidate", "new", 100)}


def test_skeleton_has_every_workload(spark, tmp_path):
    cells = spark.createDataFrame([(f"w{k:03d}", float(k)) for k in range(150)] + [("all", 1e9), ("", 5.0), (None, 5.0)], "workload string, cost_usd double")
    got = evals.eval_skeleton(cells).orderBy("rank").collect()
    assert [r.id for r in got[:2]] == ["w149_001", "w148_002"] and len(got) == 150 and evals.eval_skeleton(cells, first=7).count() == 7
    evals.write_eval_skeleton(evals.eval_skeleton(cells), str(tmp_path / "skeleton"))
    written = spark.read.json(str(tmp_path / "skeleton"))
    assert written.count() == 150 and set(written.columns) == {"id", "workload", "input", "checks"}
    assert [r.id for r in evals.eval_skeleton(cells.filter("workload = 'all'")).collect()] == ["all_001"]


# -- fingerprints ------------------------------------------------------------------------------------


def canonical(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def trip(last, **more):
    turns = [
        {"role": "system", "content": "Plan trips – café stops included."},
        {"role": "user", "content": 'From "A" to\nB', "cache_control": {"type": "ephemeral"}},
        {"role": "user", "content": last},
    ]
    return {"model": "gpt-4.1-mini", "messages": turns} | more


TRIP_BLOCKS = [
    {"role": "system", "content": "Plan trips – café stops included."},
    {"role": "user", "content": 'From "A" to\nB'},
    {"role": "user", "content": "When?"},
]
# Body and blocks of each kind of request.
BODIES = {
    "turns": (trip("When?"), TRIP_BLOCKS),
    "carried": (trip("When?", stream=False, metadata={"trip": 9}, store=True, user="u"), TRIP_BLOCKS),
    "warmer": (trip("When?", temperature=0.7), TRIP_BLOCKS),
    "parts": (
        {"messages": ["plain", {"role": "user", "content": [{"type": "text", "text": "map"}, {"type": "text", "text": "list"}]}],
         "system": [{"type": "text", "text": "one"}, {"cache_control": {}, "text": "two", "type": "text"}], "tools": [{"z": 1, "name": "route"}]},
        [{"tools": [{"name": "route", "z": 1}]}, {"system": {"type": "text", "text": "one"}}, {"system": {"type": "text", "text": "two", "cache_control": {}}},
         "plain", {"role": "user", "part": {"type": "text", "text": "map"}}, {"type": "text", "text": "list"}],
    ),
    "line": ({"input": "a line, not a list", "instructions": "short", "text": {"verbosity": "low"}, "tools": []},
             [{"text": {"verbosity": "low"}}, {"system": "short"}, {"role": "user", "content": "a line, not a list"}]),
    "events": ({"response_format": {"type": "json"}, "input": [{"type": "output", "content": [{"text": "t"}]}, {"type": "tool", "n": 2}]},
               [{"response_format": {"type": "json"}}, {"part": {"text": "t"}, "role": "output"}, {"type": "tool", "n": 2}]),
    "bare": ({"model": "x"}, []),
}


def test_blocks_and_hashes(spark):
    df = spark.createDataFrame([(n, json.dumps(b)) for n, (b, _) in BODIES.items()], "name string, body string")
    request = F.parse_json("body")
    rows = df.select("name", fingerprint.prompt_blocks(request).alias("blocks"), fingerprint.fingerprint(request, SALT).alias("fp")).collect()
    for name, blocks, fp in rows:
        texts = [canonical(b) for b in BODIES[name][1]]
        assert blocks == texts, name
        whole = ["".join(texts[: k + 1]) for k in range(len(texts))]
        assert list(fp.prefix_hashes) == [hmac.new(SALT, w.encode(), hashlib.sha256).hexdigest()[:HASH_HEX_CHARS] for w in whole]
        assert list(fp.prefix_chars) == [len(w) for w in whole]
    by_name = {r.name: r.fp.request_hash for r in rows}
    assert by_name["turns"] == by_name["carried"] != by_name["warmer"]
    assert by_name["turns"] == hmac.new(SALT, canonical(BODIES["turns"][0]).encode(), hashlib.sha256).hexdigest()[:HASH_HEX_CHARS]


def test_written_logs_hold_no_prompt(spark, put, tmp_path):
    lines = [
        {"timestamp": 5, "usage": {"input_tokens": 3}, "request": trip("HIDDEN"), "response": "HIDDEN", "choices": ["HIDDEN"], "output": "HIDDEN"},
        {"timestamp": 6, "fingerprint": {"request_hash": "given"}, "content": "HIDDEN"},
    ]
    records = request_log.parsed(request_log.read_lines(spark, put("raw.jsonl", lines)))
    fingerprint.write_redacted(records, SALT, str(tmp_path / "clean"))
    text = [r.value for r in spark.read.text(str(tmp_path / "clean")).collect()]
    assert "HIDDEN" not in "".join(text) and "café" not in "".join(text)
    first, second = sorted(map(json.loads, text), key=lambda r: r["timestamp"])
    assert set(first) == {"timestamp", "usage", "fingerprint"} and len(first["fingerprint"]["prefix_hashes"]) == 3
    assert second == {"timestamp": 6, "fingerprint": {"request_hash": "given"}}
    broken = request_log.parsed(request_log.read_lines(spark, put("broken.jsonl", [*lines, "{no"])))
    with pytest.raises(Exception, match="not a JSON line in broken.jsonl"):
        fingerprint.write_redacted(broken, SALT, str(tmp_path / "never"))
