"""Lines with their place, streams of growing files, and hand-written records of single sources."""

import json

import pytest

from meterframe.sources import feeds, lines, specs
from meterframe.streaming import ingest


def place(path, **options):
    return lambda spark: lines.registered(spark).read.format("whole_lines").options(path=str(path), **options).load()


def told(frame):
    return sorted((r.file.rsplit("/", 1)[-1], r.line, r.offset, r.size, None if r.value is None else bytes(r.value)) for r in frame.collect())


def plain(name, data, most=lines.LINE_LIMIT):
    out, at = [], 3 if data.startswith(b"\xef\xbb\xbf") else 0
    for number, line in enumerate(data[at:].split(b"\n")[:-1], 1):
        text = line.removesuffix(b"\r")
        out.append((name, number, at, len(text) if len(line) <= most + 1 else len(line), text if len(text) <= most else None))
        at += len(line) + 1
    return out


FILES = {"a": b"\xef\xbb\xbf{}\r\n\n{\"x\": 1}\nlast without end", "b": b"", "c": b"\n\n\n", "d": b"no end at all", "e": "é\n漢字\r\n".encode() * 40 + b"\xff\xfe\n", "f": b"x" * 500 + b"\n" + b"y" * 20 + b"\n"}


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 26])
def test_lines_have_their_place_however_files_are_split(spark, tmp_path, split):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"no data\n")
    found = lines.numbered(place(tmp_path, split=split, most=100)(spark))
    assert told(found) == sorted(x for name, data in FILES.items() for x in plain(name, data, 100))
    assert place(tmp_path / "nothing")(spark).count() == 0


def test_bad_lines_are_named_by_place(spark, tmp_path):
    (tmp_path / "log").write_bytes(b'{"k": 1}\n\nnot json\n[1]\n{"k": 2}\r\n\xff{\n{"k": "' + b"x" * feeds.LINE_LIMIT + b'"}\n{"k": 3}\n{"k"')
    good, bad = feeds.read_lines(spark, str(tmp_path), "k bigint")
    assert sorted((r.line, r.offset, r.k) for r in good.collect()) == [(1, 0, 1), (5, 23, 2), (8, 36 + feeds.LINE_LIMIT + 10, 3)]
    assert sorted((r.line, r.offset, r.fault) for r in bad.collect()) == [(3, 10, "not_an_object"), (4, 19, "not_an_object"), (6, 33, "invalid_utf8_line"), (7, 36, "line_too_long")]


def test_growing_files_are_read_line_by_line_once(spark, tmp_path):
    """Half a line waits for its end, a restart goes on, a replay gives the same rows, and a replaced file begins anew."""
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    seen: dict[int, list] = {}

    def sink(rows, number):
        got = sorted((r.file.rsplit("/", 1)[-1], r.line, r.offset, r.value, r.fault) for r in rows.collect())
        assert seen.setdefault(number, got) == got

    def run():
        ingest.ingest_lines(spark, str(folder), str(state), sink, split=5).trigger(availableNow=True).start().awaitTermination(120)

    a, b = folder / "a", folder / "b"
    a.write_bytes(b"\xef\xbb\xbfone\ntwo\nhal")
    run()
    with a.open("ab") as f:
        f.write(b"f\n\nfour")
    b.write_bytes(b"b1\n")
    run()
    with a.open("ab") as f:
        f.write(b"\n\xff\n")
    run()
    b.write_bytes(b"other file\nwith two lines\n")
    run()
    run()
    assert [seen[k] for k in sorted(seen)] == [
        [("a", 1, 3, "one", None), ("a", 2, 7, "two", None)],
        [("a", 3, 11, "half", None), ("b", 1, 0, "b1", None)],
        [("a", 5, 17, "four", None), ("a", 6, 22, None, "invalid_utf8_line")],
        [("b", 1, 0, "other file", None), ("b", 2, 11, "with two lines", None)],
    ]
    # the totals of a batch that is run again are those from before it
    held = ingest.line_totals(spark, str(state), 2)
    assert {r.file.rsplit("/", 1)[-1]: r.total for r in held.collect()} == {"a": 4, "b": 1}


def test_totals_are_folded(spark, tmp_path):
    for number in range(2 * ingest.FOLD + 3):
        rows = spark.createDataFrame([(f"f{number % 3}", True, 0, 0)], "file string, fresh boolean, split long, turn long")
        if number % ingest.FOLD < 2 or number > 2 * ingest.FOLD:
            ingest.store_totals(spark, str(tmp_path), number, rows, ingest.line_totals(spark, str(tmp_path), number))
    assert {r.file: r.total for r in ingest.line_totals(spark, str(tmp_path), 2 * ingest.FOLD + 3).collect()} == {"f0": 1, "f1": 1, "f2": 1}


def usage(**more):
    return {"model": "m", "usage": {"input_tokens": 5, "cache_read_input_tokens": 1, "cache_creation_input_tokens": 2, "output_tokens": 3}, **more}


def test_long_and_broken_records_are_told(spark, tmp_path):
    folder = tmp_path / "claude"
    folder.mkdir()
    sound = json.dumps({"type": "assistant", "requestId": "r1", "timestamp": "2024-01-01T00:00:00Z", "message": usage()})
    (folder / "s.jsonl").write_text(f'{sound}\n{{"type": "assistant", "x": "{"y" * (9 << 20)}"}}\n{{broken\n{{"type": "user"}}\n')
    events, faults = specs.read_lines(spark, str(folder), specs.SPECS["claude-code"])
    assert [(r.record_key, r.line, r.input_total) for r in events.collect()] == [("req:r1", 1, 8)]
    assert sorted((r.line, r.fault) for r in faults.collect()) == [(2, "line_too_long"), (3, "not_an_object")]
    docs = tmp_path / "gemini"
    docs.mkdir()
    message = {"type": "gemini", "id": "g", "timestamp": "2024-01-01T00:00:00Z", "model": "m", "tokens": {"input": 1, "output": 2, "cached": 0, "thoughts": 0}}
    (docs / "long.json").write_text(json.dumps({"sessionId": "s", "pad": "p" * (9 << 20), "messages": [message, {**message, "id": None}, {"type": "user"}]}))
    (docs / "bad.json").write_text("{")
    (docs / "none.json").write_text('{"sessionId": "s"}')
    events, faults = specs.read_lines(spark, str(docs), specs.SPECS["gemini"])
    assert sorted(r.record_key for r in events.collect()) == ["gemini:s:g", "gemini:s:idx-1"]
    assert sorted((r.file.rsplit("/", 1)[-1], r.fault) for r in faults.collect()) == [("bad.json", "not_a_document"), ("none.json", "no_messages")]


def test_identities_of_hand_written_records(spark):
    kimi = {"type": "usage.record", "time": 1704067200000, "model": "m", "usage": {"inputOther": 1, "inputCacheRead": 0, "inputCacheCreation": 0, "output": 2}}
    genai = {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "model": "m", "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2}}
    codex = {"type": "token_usage_record", "timestamp": "2024-01-01T00:00:00Z", "payload": {"model": "m", "usage": dict.fromkeys(("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens"), 1)}}
    claude = {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": usage()}
    pi = {"type": "message", "id": "a1", "parentId": None, "timestamp": "2026-01-05T15:00:02.000Z", "message": {"model": "m", "usage": {"input": 1, "cacheRead": 0, "cacheWrite": 0, "output": 1}}}
    span = {"name": "chat", "spanId": "s1", "startTime": "2024-01-01T00:00:00Z", "attributes": {"gen_ai.usage.input_tokens": 1, "gen_ai.usage.output_tokens": 1}}
    cases = {
        "kimi-code": ([kimi, kimi, {**kimi, "time": 1704067200001}, kimi], ["kimi-code:usage:ses:main:1704067200000:0", "kimi-code:usage:ses:main:1704067200000:1", "kimi-code:usage:ses:main:1704067200000:2", "kimi-code:usage:ses:main:1704067200001:0"]),
        "qwen": ([{**genai, "uuid": "u"}, genai, {**genai, "sessionId": "s"}], ["qwen:u", "seq:s:3", "seq:unknown-session:2"]),
        "codex": ([{**codex, "payload": {**codex["payload"], "response_id": "r"}}, codex], ["resp:r", "seq:unknown-session:2"]),
        "claude-code": ([{**claude, "message": usage(id="i")}, {**claude, "uuid": "u"}, {**claude, "sessionId": "s"}, {**claude, "requestId": "q", "uuid": "u"}], ["msg:i", "req:q", "seq:s:3", "uuid:u"]),
        "pi": ([pi], ["pi:message:a1:-:2026-01-05T15:00:02.000Z"]),
        "otel": ([span, {**span, "traceId": "t"}], ['otel:["t","s1"]', "otel:s1"]),
    }
    for name, (records, keys) in cases.items():
        frame = spark.createDataFrame([("/x/ses/agents/main/wire.jsonl", k, json.dumps(r)) for k, r in enumerate(records, 1)], "file string, line long, value string")
        events, faults = specs.read(frame, specs.SPECS[name])
        assert sorted(r.record_key for r in events.collect()) == keys and faults.count() == 0, name


def test_a_folder_of_mixed_writers(spark, tmp_path):
    """Files are told apart by their names, versions by their records; what no source or version fits is a fault."""
    claude = json.dumps({"type": "assistant", "requestId": "r1", "version": "9.9", "timestamp": "2024-01-01T00:00:00Z", "message": usage()})
    pi = [{"type": "session", "version": 3}, {"type": "message", "id": "a", "timestamp": "2024-01-01T00:00:00Z", "message": {"model": "m", "usage": {"input": 1, "cacheRead": 0, "cacheWrite": 0, "output": 1}}}]
    gemini = {"sessionId": "s", "messages": [{"type": "gemini", "id": "g", "timestamp": "2024-01-01T00:00:00Z", "model": "m", "tokens": {"input": 1, "output": 2}}]}
    files = {
        ".claude/projects/p/one.jsonl": claude + "\n{broken\n",
        ".claude/projects/p/two.jsonl": '{"other": 1}\n',
        ".pi/agent/sessions/x/three.jsonl": "".join(json.dumps(r) + "\n" for r in pi),
        ".gemini/tmp/h/chats/session-4.json": json.dumps(gemini),
        ".gemini/tmp/h/chats/session-5.json": '{"sessionId": "s", "messages": 7}',
        "notes/six.txt": "no log\n",
    }
    for name, text in files.items():
        (tmp_path / "home" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "home" / name).write_text(text)
    path = str(tmp_path / "home")
    short = lambda file: file.rsplit("/", 1)[-1]
    assert {short(r.file): r.agent for r in specs.discover(spark, path).collect()} == {"one.jsonl": "claude-code", "two.jsonl": "claude-code", "three.jsonl": "pi", "session-4.json": "gemini", "session-5.json": "gemini", "six.txt": None}
    held = {k: specs.SPECS[k] for k in ("claude-code", "pi", "gemini")}
    events, faults = specs.scan(spark, path, held)
    assert sorted((r.agent, short(r.file), r.basis, r.record_key) for r in events.collect()) == [
        ("claude-code", "one.jsonl", "latest_fallback", "req:r1"), ("gemini", "session-4.json", "latest_fallback", "gemini:s:g"), ("pi", "three.jsonl", "known_version", "pi:message:a:-:2024-01-01T00:00:00Z"),
    ]
    assert sorted((short(r.file), r.line, r.fault) for r in faults.collect() if r.line) == [("one.jsonl", 2, "not_an_object")]
    assert sorted((short(r.file), r.fault) for r in faults.collect() if not r.line) == [("session-5.json", "no_messages"), ("session-5.json", "no_version_fits"), ("six.txt", "unknown_source"), ("two.jsonl", "no_version_fits")]
    told = {(r.agent, r.part): r.told for r in specs.capability(spark).collect()}
    assert told["gemini", "input"] == "always" and told["gemini", "write"] == "never" and told["codex", "reasoning"] == "always"


def test_table_scans_read_new_rows_by_type(spark, tmp_path):
    rows = [(1, '{"k": 1}'), (2, '{"k": 2, "n": 1.5, "t": "x"}'), (3, '{"k": "3"}'), (4, '{"k": 4.5}'), (5, '{"k": 5, "t": 7}'), (6, None), (7, "7"), (8, '{"t": "x"}'), (9, '{"k": 9, "t": null}')]
    spark.createDataFrame(rows, "id long, data string").write.parquet(f"{tmp_path}/t")
    fields = {"k": ("$.k", ("BIGINT",), True), "n": ("$.n", ("DOUBLE", "DECIMAL", "BIGINT"), False), "t": ("$.t", ("STRING",), False)}
    good, bad = feeds.table_scan(spark.read.parquet(f"{tmp_path}/t"), "id", 1, "data", fields)
    assert sorted((r.id, r.k, r.n, r.t) for r in good.collect()) == [(2, 2, 1.5, "x"), (9, 9, None, None)]
    assert {r.id: r.fault for r in bad.collect()} == {3: "wrong_type:k", 4: "wrong_type:k", 5: "wrong_type:t", 6: "not_an_object", 7: "not_an_object", 8: "required_missing:k"}
    assert "GreaterThan(id,1)" in good._jdf.queryExecution().toString()
