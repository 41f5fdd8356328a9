"""Events of a folder, over restarts."""

import os
import time

from quillgraph.streaming import listing as L


def test_events_and_restart(spark, tmp_path):
    root, state = tmp_path / "notes", f"file://{tmp_path}/state"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("a")
    (root / "sub" / "b c.md").write_text("b")
    (root / "x.txt").write_text("no")
    poll = lambda v, now=99: {(r.path, r.event) for r in L.poll(spark, f"file://{root}", state, v, now).collect()}
    assert poll(0) == {("a.md", "add"), ("sub/b c.md", "add")}
    assert poll(1) == set()
    (root / "a.md").write_text("longer")
    (root / "sub" / "b c.md").unlink()
    (root / "d.md").write_text("d")
    assert poll(2) == {("a.md", "change"), ("sub/b c.md", "unlink"), ("d.md", "add")}
    (root / "d.md").unlink()
    assert poll(2, 500) == {("a.md", "change"), ("sub/b c.md", "unlink"), ("d.md", "add")}  # repeated: the same
    assert L.poll(spark, f"file://{root}", state, 2, 500).filter("event = 'unlink'").first().ms == 99
    assert poll(3) == {("d.md", "unlink")}


def test_stream(spark, tmp_path):
    root, state = tmp_path / "notes", f"file://{tmp_path}/state"
    root.mkdir()
    (root / "a.md").write_text("a")
    seen: dict[int, set] = {}

    def handle(events, number):
        seen[number] = {(r.path, r.event) for r in events.collect()}

    def until(event):
        for _ in range(120):
            if any(event in x for x in seen.values()):
                return True
            time.sleep(0.5)
        return False

    q = L.watch(spark, f"file://{root}", state, handle, "1 second")
    try:
        assert until(("a.md", "add"))
    finally:
        q.stop()
    os.remove(root / "a.md")
    (root / "b.md").write_text("b")
    q = L.watch(spark, f"file://{root}", state, handle, "1 second")  # what happened meanwhile is told after the restart
    try:
        assert until(("a.md", "unlink")) and until(("b.md", "add"))
    finally:
        q.stop()
    assert sum(("a.md", "add") in x for x in seen.values()) == 1
