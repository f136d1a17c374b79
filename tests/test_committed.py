"""Published versions: a run that dies before it publishes leaves the table as it was, a batch run twice changes nothing."""

import pytest

from loomtext.streaming.committed import Conflict, Versions, refresh


def feed(spark, *ids):
    return spark.createDataFrame([(i, f"title {i}") for i in ids], "id long, title string")


def ids(table):
    return sorted(r["id"] for r in table.read().collect())


def test_refresh(spark, tmp_path):
    table, given = Versions(spark, str(tmp_path / "t")), []
    sink = lambda rows: given.append(sorted(r["id"] for r in rows.where("is_new").collect()))
    assert table.read() is None and table.manifest() is None
    first = refresh(table, "b1", feed(spark, 1, 2), "id", sink)
    assert (first["version"], first["state"]) == (1, {"length_curr": 2, "length_old": 2}) and ids(table) == [1, 2] and given == [[1, 2]]

    def fails(rows):
        raise OSError("the sink is full")

    with pytest.raises(OSError):
        refresh(table, "b2", feed(spark, 2, 3, 4), "id", fails)
    assert table.manifest() == first and ids(table) == [1, 2], "what was written but not published isn't there"
    again = Versions(spark, str(tmp_path / "t"))  # the run after the crash
    second = refresh(again, "b2", feed(spark, 2, 3, 4), "id", sink)
    assert ids(again) == [1, 2, 3, 4] and given[-1] == [3, 4] and second["state"] == {"length_curr": 4, "length_old": 4}
    assert refresh(again, "b2", feed(spark, 9), "id", sink) == second and len(given) == 2 and ids(again) == [1, 2, 3, 4], "the same batch changes nothing"
    assert again.sweep() == 1 and again.sweep() == 0 and ids(again) == [1, 2, 3, 4]
    third = refresh(again, "b3", feed(spark, 5), "id", sink, hand=spark.createDataFrame([(1, "by hand")], "id long, title string"), keep_new=True)
    assert third["state"] == {"length_curr": 5, "length_old": 4} and {r["id"]: r["title"] for r in again.read().collect()}[1] == "by hand"
    assert again.read().columns == ["id", "title", "is_new"]


def test_kill_between_write_and_publish(spark, tmp_path, monkeypatch):
    """The process stops after the rows are written and before the rename: the last version stays, the batch runs again."""
    table = Versions(spark, str(tmp_path / "t"))
    table.publish("a", lambda _: feed(spark, 1))
    real = table._fs

    class Dies:
        def __getattr__(self, name):
            if name == "rename":
                raise KeyboardInterrupt
            return getattr(real, name)

    table._fs = Dies()
    with pytest.raises(KeyboardInterrupt):
        table.publish("b", lambda old: old.union(feed(spark, 2)))
    after = Versions(spark, str(tmp_path / "t"))
    assert after.manifest()["version"] == 1 and ids(after) == [1]
    assert after.publish("b", lambda old: old.union(feed(spark, 2)))["version"] == 2 and ids(after) == [1, 2]


def test_two_writers(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    other = Versions(spark, str(tmp_path / "t"))
    with pytest.raises(Conflict):
        table.publish("mine", lambda _: feed(spark, 1), before=lambda _: other.publish("theirs", lambda _: feed(spark, 2)))
    assert ids(table) == [2] and table.manifest()["batch"] == "theirs"
