import json
import os

from graphloom.plans import metrics, render
from graphloom.streaming import watch
from tests import graphs


def test_debounce_in_batch(spark):
    rows = [("a", 0.0), ("b", 1.5), ("a", 3.0), ("c", 9.0)]
    df = spark.createDataFrame(rows, "path string, s double").selectExpr("path", "timestamp_millis(bigint(s * 1000)) AS ts")
    got = sorted((r["paths"], r["n_events"]) for r in watch.debounce(df).collect())
    assert got == [(["a", "b"], 3), (["c"], 1)]


def test_stream_flushes_bursts_once(spark, tmp_path):
    folder, seen, tries = tmp_path / "events", [], []
    os.makedirs(folder)
    lines = [{"path": p, "ts": f"2024-01-01T00:00:{s:02}.000Z"} for p, s in (("a", 0), ("b", 1), ("c", 20), ("z", 59))]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))

    def sync(paths):
        tries.append(paths)
        if len(tries) == 1:
            raise BlockingIOError
        seen.append(sorted(paths))

    query = watch.flush_to(watch.debounce(watch.events(spark, str(folder))), sync, str(tmp_path / "cp"))
    query.processAllAvailable()
    (folder / "2.json").write_text(json.dumps({"path": "late", "ts": "2024-01-01T00:05:00.000Z"}))
    query.processAllAvailable()
    query.stop()
    assert [p for batch in seen for p in batch][:3] == ["a", "b", "c"] and len(tries) > len(seen)


def test_gate_and_cover(spark):
    names = "subject string, goos string, goarch string, runner string, scratch_fs string, files_per_sec double, peak_rss_bytes long"
    base = spark.createDataFrame([("a", "l", "x", "r", "d", 100.0, 100), ("b", "l", "x", "r", "d", 100.0, 100)], names)
    now = spark.createDataFrame([("a", "l", "x", "r", "d", 91.0, 114), ("b", "l", "x", "r", "d", 89.0, 90), ("c", "l", "x", "r", "d", 1.0, 1)], names)
    got = {r["subject"]: r["reason"] for r in metrics.gate(now, base).collect()}
    assert got == {"a": "", "b": "throughput", "c": "no baseline"}
    counts = spark.createDataFrame([("r1", "calls", 9), ("r2", "calls", 4), ("r2", "embeds", 3), ("r3", "embeds", 1)], "repo string, kind string, n long")
    assert {(r["kind"], r["repo"], r["threshold"]) for r in metrics.coverage(counts).collect()} == {("calls", "r1", 4), ("embeds", "r2", 2)}
    sizes = spark.createDataFrame([("r1", 5), ("r2", 50), ("r3", 1)], "repo string, tracked_files long")
    assert metrics.smallest_cover(counts, sizes, ["r1", "r2", "r3"]).first()["names"] == ["r2"]


def test_watch_policy_and_volatile_keys(tmp_path):
    import subprocess

    from graphloom.sources import worktree

    assert watch.why_not_watch("/x", env={}) == "" and watch.why_not_watch("/x", no_watch=True, force=True, env={})
    assert watch.why_not_watch("/mnt/c/x", wsl=True, env={}) and not watch.why_not_watch("/mnt/c/x", wsl=True, force=True, env={})
    assert watch.quiet_gap({}) == watch.QUIET and watch.quiet_gap({"GRAPHLOOM_DEBOUNCE_MS": "50"}) == "50 milliseconds"
    assert metrics.without_volatile({"a": [{"stale": 1, "b": 2, "created_at": 3}], "score": 1}) == {"a": [{"b": 2}]}
    main, other = tmp_path / "main", tmp_path / "other"
    git = lambda *a: subprocess.run(["git", "-C", str(main), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    main.mkdir()
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "x")
    git("worktree", "add", "-q", str(other))
    assert worktree.mismatch(str(other), str(main)) == (str(other), str(main))
    assert worktree.mismatch(str(main), str(main)) is None and worktree.mismatch(str(tmp_path), str(main)) is None


def test_renderers(spark):
    from graphloom.operators import lookup, status, traverse

    n, e = graphs.chain(spark)
    found = traverse.callers(n, e, "helper")
    assert json.loads(render.callers_json("helper", found)) == {"symbol": "helper", "callers": [{"name": "Alpha", "kind": "function", "filePath": "Alpha.go", "startLine": 1}]}
    assert "| `Alpha` | function | `Alpha.go:1` |" in render.callers_markdown("helper", found)
    assert render.callers_markdown("main", traverse.callers(n, e, "main")) == "**Callers of `main`** — no callers found.\n"
    node = json.loads(render.query_json(lookup.query(n, "main")))[0]["node"]
    assert node["visibility"] is None and "signature" not in node and node["isAsync"] is False
    assert render.dump("<a&b>") == '"\\u003ca\\u0026b\\u003e"' and render.megabytes(1 << 20) == "1.00 MB" and render.number(1234567) == "1,234,567"
    table = status.status(n, e, n.selectExpr("file_path AS path", "'go' AS language"))
    assert "- calls: 3" in render.status_markdown(table, 10)
    assert "depth 2, 3 nodes, 2 edges" in render.impact_markdown("helper", 2, traverse.impact(n, e, "helper"))
