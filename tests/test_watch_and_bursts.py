"""The note source and bursts on streams, against plain comparisons."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from loomtext.config import Config
from loomtext.plans import build
from loomtext.sources import watch
from loomtext.streaming import bursts
from loomtext.streaming import events as streaming

SCHEMA = "event_id int, ts string, file_path string, old_path string, op string"


def put(path, text, ns=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    if ns:
        os.utime(path, ns=(ns, ns))


def test_bursts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Four batches with a restart before each: events out of order, a gap of just the quiet time, a rename, one note that is late."""
    rows = lambda x: spark.createDataFrame(x, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    day = "2026-01-01 00:"
    parts = [
        [(1, day + "00:00", "a.md", None, "modify"), (2, day + "00:30", "a.md", None, "delete"), (3, day + "00:10", "b.md", "c.md", "rename"), (4, day + "00:10", "x.txt", None, "create"), (None, None, "n.md", None, "create"), (5, day + "00:10", None, None, "create")],
        [(6, day + "01:00", "a.md", None, "modify"), (7, day + "00:20", "b.md", None, "modify"), (7, day + "00:20", "b.md", None, "modify")],
        [(8, day + "05:00", "z.md", None, "modify"), (9, day + "00:40", "a.md", None, "create"), (10, day + "00:31", "d.md", None, "create"), (11, day + "00:59", "d.md", None, "delete"), (12, day + "00:45", "d.md", None, "modify")],
    ]
    late = [(13, day + "00:05", "a.md", None, "modify"), (14, day + "00:06", "a.md", None, "delete"), (15, day + "09:00", "y.md", None, "modify")]
    for part in [*parts, late]:
        rows(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows(part).schema).parquet(f"{tmp_path}/in")
        out = bursts.debounced_stream(stream, "30 seconds", "1 minute")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.schema(bursts.OUT).parquet(f"{tmp_path}/out").collect()}
    table = streaming.debounced(rows(sum(parts, [])), "30 seconds").select("path", "burst_start", "burst_end", "op", "n")
    assert {r[:5] for r in got if not r[5]} == {tuple(r) for r in table.collect()}
    assert [(r[0], r[3], r[4]) for r in got if r[5]] == [("a.md", "deleted", 2)]  # y.md is still open, z.md is not


def test_merging_is_the_same_in_any_order():
    import numpy as np
    import pandas as pd

    g = np.random.default_rng(3)
    t = g.integers(0, 400, 200)
    rows = pd.DataFrame({"path": g.choice(["a", "b"], 200), "start": t, "end": t, "at": t, "event_id": np.arange(200), "op": g.choice(["changed", "deleted"], 200), "n": 1})
    whole = bursts.merged(rows, 7)
    pieces = pd.concat([bursts.merged(rows[k::5], 7) for k in range(5)])
    key = ["path", "start"]
    assert bursts.merged(pieces, 7).sort_values(key).to_dict("records") == whole.sort_values(key).to_dict("records")
    assert whole["n"].sum() == 200 and len(whole) > 4
    for _, own in whole.sort_values(key).groupby("path"):
        assert (own["start"].to_numpy()[1:] - own["end"].to_numpy()[:-1] > 7).all()


def test_note_source_as_a_batch(spark, tmp_path):
    spark.dataSource.register(watch.Notes)
    root = tmp_path / "vault"
    put(root / "top.md", "top")
    put(root / "a/deep/er/x.md", b"bad \xff byte")
    put(root / "b/y.MD", "upper")
    put(root / "b/no.txt", "no note")
    (root / "empty").mkdir()
    for depth in (0, 1, 2):
        got = {r["file_path"]: (r["text"], r["file_size"]) for r in spark.read.format("notes").option("depth", depth).load(str(root)).collect()}
        assert got == {"top.md": ("top", 3), "a/deep/er/x.md": ("bad � byte", 10), "b/y.MD": ("upper", 5)}
    with pytest.raises(Exception, match="no folder"):
        spark.read.format("notes").load(str(root / "none")).collect()
    with pytest.raises(Exception, match="snapshots"):
        spark.readStream.format("notes").load(str(root)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "none")).start().awaitTermination()


def test_replayed_batches_compare_the_same_listings(tmp_path):
    root = tmp_path / "vault"
    put(root / "a/x.md", "1", 10**18)
    put(root / "gone/z.md", "1", 10**18)
    stream = watch.NoteStream({"path": str(root), "snapshots": str(tmp_path / "snap")})
    events = lambda s, e: sorted((r[2], r[4]) for p in stream.partitions(s, e) for r in stream.read(p))
    zero, one, two = stream.initialOffset(), {"at": 5}, {"at": 9}
    first = events(zero, one)
    assert first == [("a/x.md", "create"), ("gone/z.md", "create")]
    put(root / "a/x.md", "2", 2 * 10**18)  # the same size, another time
    put(root / "new/y.md", "1")
    shutil.rmtree(root / "gone")
    assert events(zero, one) == first  # what is written stands, whatever has come since
    second = events(one, two)
    assert second == [("a/x.md", "modify"), ("gone/z.md", "delete"), ("new/y.md", "create")]
    stream.commit(two)
    assert stream._times() == [9] and stream.latestOffset()["at"] > 9
    assert events(two, {"at": 12}) == []
    shutil.rmtree(root)
    with pytest.raises(FileNotFoundError):
        events({"at": 12}, {"at": 15})


def test_watched_notes_keep_an_index(spark, tmp_path):
    """Files as they are, the stream of what became of them, and the index: the same as building it anew."""
    spark.dataSource.register(watch.Notes)
    root, config = tmp_path / "vault", Config()
    for i in range(8):
        put(root / f"f{i % 3}/n{i}.md", f"# T{i}\n\nwords of note {i}", 10**18)
    (root / "f0/empty.md").write_text("")
    notes = lambda: watch.scan(spark, str(root), config)
    keeper = streaming.IndexSync(spark, f"{tmp_path}/index", notes, lambda n: build.note_tables(n, config), config)
    keeper.start()
    stream = lambda: watch.watched(spark, str(root), f"{tmp_path}/snap")
    content = lambda t: {tuple(map(str, r)) for r in t["chunks"].select("file_path", "chunk_index", "content").collect()}
    for turn in range(2):
        streaming.stream_sync(stream(), keeper.apply, f"{tmp_path}/cp").awaitTermination()
        assert content(keeper.tables()) == content(build.note_tables(notes(), config)), turn
        put(root / "f1/n1.md", "changed words", 2 * 10**18)
        (root / "f2/n2.md").unlink(missing_ok=True)
        put(root / "f9/new.md", "new words", 10**18)
    assert {r["file_path"] for r in keeper.tables()["file_state"].collect()} == {"f0/empty.md", "f9/new.md", *(f"f{i % 3}/n{i}.md" for i in range(8) if i != 2)}


def test_joined_bursts_of_a_path():
    """Bursts as tuples, which the stream keeps, are joined as they are in a table."""
    import numpy as np
    import pandas as pd

    g = np.random.default_rng(4)
    names = [x.split()[0] for x in bursts.BURST.split(", ")]
    for n in (1, 2, 60):
        start = g.integers(0, 300, n)
        rows = pd.DataFrame({"path": "a", "start": start, "end": start + g.integers(0, 9, n), "at": start, "event_id": g.integers(-1, 3, n), "op": g.choice(["changed", "deleted"], n), "n": 1})
        assert bursts.joined(list(rows[names].itertuples(index=False, name=None)), 5) == list(bursts.merged(rows, 5)[names].itertuples(index=False, name=None))
