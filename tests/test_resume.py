"""Resume as a stream: restarts, redelivered, late and partial rows, and the same table as append_once gives."""

import pytest
from pyspark.sql import functions as F

from tamarack import sources
from tamarack.streaming import resume

KEYS, SCHEMA = ["dataset", "method"], "dataset string, method string, trial_uid string, y_score double, session int, n_expected long"


def rows(dataset, method, n, which):
    return [(dataset, method, f"t{k}", k / 7, None if k % 2 else k, n) for k in which]


class Feed:
    """A folder whose files are the batches, and the stream that reads them, started anew for each."""

    def __init__(self, spark, root, **more):
        self.spark, self.root, self.more = spark, str(root), more

    def add(self, *parts):
        self.spark.createDataFrame([r for p in parts for r in p], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in")
        query = resume.written_whole(stream, f"{self.root}/out", f"{self.root}/checkpoint", KEYS, ["trial_uid"], **self.more)
        assert query.awaitTermination(120)
        return query

    def table(self):
        return self.spark.read.parquet(f"{self.root}/out")

    def of(self, status):
        return sorted((tuple(r) for r in self.table().filter(F.col("status") == status).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()), key=str)


def test_restarts_and_late_parts(spark, tmp_path):
    feed = Feed(spark, tmp_path, patience_s=0)
    a, b, c = (rows("D", m, n, range(n)) for m, n in (("a", 5), ("b", 6), (None, 4)))
    feed.add(a, b[:3], c[:2], [c[0]])
    feed.run()
    assert feed.of("complete") == sorted(a, key=str) and feed.of("partial") == []
    feed.add(b[2:], a)  # the rest, with what was there before
    feed.run()
    assert feed.of("complete") == sorted(a + b, key=str) and feed.of("partial") == sorted(c[:2], key=str) and feed.of("late") == []
    feed.add(c[2:], a[:1])
    feed.run()
    assert feed.of("late") == sorted(c[2:], key=str) and feed.of("complete") == sorted(a + b, key=str)
    assert feed.table().count() == len(a + b + c)


def test_equal_to_append_once(spark, tmp_path):
    """Five batches in any order, with repeats, against one table after another through append_once."""
    old = rows("D", "old", 3, range(3))
    sets = [rows("D", m, n, range(n)) for m, n in (("a", 4), ("b", 1), ("c", 7), ("old", 3))]
    batches = [sets[0] + sets[2][:3], sets[3] + sets[1], sets[2][3:5], sets[2][5:] + sets[0], sets[1]]
    before = spark.createDataFrame(old, SCHEMA)
    feed = Feed(spark, tmp_path, done=resume.counted(before, KEYS))
    for batch in batches:
        feed.add(batch)
        feed.run()
    want = before
    for s in sets:
        want = want.unionByName(sources.append_once(spark.createDataFrame(s, SCHEMA), want, KEYS))
    assert sorted(feed.of("complete") + old, key=str) == sorted((tuple(r) for r in want.collect()), key=str)


@pytest.mark.parametrize("done,batch,said", [
    (None, rows("D", "a", 4, range(2)) + rows("D", "a", 3, range(2, 3)), "expects"), (None, rows("D", "a", 2, range(3)), "has 3"), (rows("D", "a", 4, range(2)), rows("D", "a", 4, range(4)), "partial append"),
])
def test_what_cannot_be_right_raises(spark, tmp_path, done, batch, said):
    feed = Feed(spark, tmp_path, done=done and resume.counted(spark.createDataFrame(done, SCHEMA), KEYS))
    feed.add(batch)
    with pytest.raises(Exception, match=said):
        feed.run()
