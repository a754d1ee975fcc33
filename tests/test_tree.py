"""Streams of a tree's changes."""

import os

from loomgraph.operators.merge import Versions
from loomgraph.plans import index
from loomgraph.streaming import tree, watch


def test_changes_of_listings():
    a = {"a": [1, 1], "b": [2, 2], "c": [3, 3], "d": [4, 4], "e": [4, 4]}
    b = {"a": [9, 1], "b2": [2, 2], "d": [4, 4], "n": [5, 5], "x": [6, 6]}
    assert tree.changes(a, b) == [("a", "write"), ("b", "rename"), ("b2", "create"), ("c", "remove"), ("e", "remove"), ("n", "create"), ("x", "create")]
    # two files that look the same: which became which can't be told
    assert tree.changes({"d": [4, 4], "e": [4, 4]}, {"f": [4, 4], "g": [4, 4]}) == [("d", "remove"), ("e", "remove"), ("f", "create"), ("g", "create")]
    assert tree.changes(a, a) == [] and tree.changes({}, {"a": [1, 1]}) == [("a", "create")]


def test_all_kinds_arrive_and_a_restart_goes_on(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for n in ("a.py", "b.py", "sub/c.py", ".git/x"):
        (root / n).write_text(n)
    got = []

    def started():
        rows = tree.tree_changes(spark, f"file://{root}", "p", f"file://{tmp_path}/state")
        return watch.in_batches(rows, lambda df, k: got.extend((r.path, r.kind, r.project) for r in df.orderBy("event_id").collect()), f"{tmp_path}/checkpoint", "100 milliseconds")

    def seen():
        out, got[:] = list(got), []
        return out

    query = started()
    try:
        query.processAllAvailable()
        assert seen() == []  # what is there at the start is no change
        (root / "a.py").write_text("changed")
        (root / "b.py").rename(root / "sub/b2.py")
        (root / "sub/c.py").unlink()
        (root / "new.go").write_text("package new")
        os.utime(root / "sub/b2.py", ns=(7, 7_000_000_000))  # so it is a file gone and another come
        query.processAllAvailable()
        first = sorted({k: v for k, v, _ in seen()}.items())
        assert [p for p, _ in first] == ["a.py", "b.py", "new.go", "sub/b2.py", "sub/c.py"] and dict(first)["sub/c.py"] == "remove" and dict(first)["new.go"] == "create"
    finally:
        query.stop()
    # while nothing runs
    (root / "new.go").rename(root / "newer.go")
    (root / "a.py").write_text("changed again")
    query = started()
    try:
        query.processAllAvailable()
        assert seen() == [("a.py", "write", "p"), ("new.go", "rename", "p"), ("newer.go", "create", "p")]
        query.processAllAvailable()
        assert seen() == []
    finally:
        query.stop()


def test_what_a_batch_brought_can_be_told_again(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    reader = tree._Reader({"root": f"file://{root}", "state": f"file://{tmp_path}/state", "from": "nothing"})
    (root / "a").write_text("a")
    start = reader.initialOffset()
    rows, end = reader.read(start)
    first = list(rows)
    (root / "a").unlink()
    rows, last = reader.read(end)
    second = list(rows)
    assert [r[:2] for r in first] == [("a", "create")] and [r[:2] for r in second] == [("a", "remove")]
    assert list(reader.readBetweenOffsets(start, last)) == first + second and list(reader.readBetweenOffsets(end, last)) == second
    assert reader.read(last)[1] == last and list(reader.read(last)[0]) == []
    reader.commit(last)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["2.json"]


def test_the_store_follows_the_tree(spark, tmp_path):
    root, store = tmp_path / "src", Versions(spark, f"file://{tmp_path}/store")
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("def one():\n    pass\n")
    (root / "b.py").write_text("def two():\n    pass\n")
    index.index(spark, f"file://{root}", store, "p", "r1")
    symbols = lambda: {(r.source_file, r.label) for r in store.read("nodes").where("type = 'symbol'").collect()}
    query = tree.follow(spark, f"file://{root}", "p", store, f"file://{tmp_path}/state", f"{tmp_path}/checkpoint", "100 milliseconds")
    try:
        query.processAllAvailable()
        (root / "a.py").unlink()
        (root / "b.py").rename(root / "sub/b.py")
        (root / "c.go").write_text("package c\n\nfunc Three() {}\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert symbols() == {("sub/b.py", "two"), ("c.go", "Three")} and index.dangling(store).count() == 0
