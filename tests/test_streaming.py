"""Streams: winners from a state store, restarts, late rows, a supervised subscription, deltas set aside."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import latest
from tidemark.operators.verify import Rejected
from tidemark.streaming import lww

SCHEMA = "subject_id string, version long, is_tomb boolean, sig string, title string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def rows(*made):
    return [(s, v, t, sig, f"{s} {v} {sig}") for s, v, t, sig in made]


def put(spark, folder, made):
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_changes_restart_and_late_rows(rocks, tmp_path):
    """Three runs from one checkpoint: what wins is emitted, late and repeated rows aren't, and all changes amount to the batch's winners."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        rows(("a", 1, False, "x"), ("b", 5, False, "x"), ("b", 4, False, "y")),
        rows(("a", 2, True, "x"), ("b", 3, False, "z"), ("c", 1, False, "x")),
        rows(("a", 2, False, "z"), ("a", 1, True, "z"), ("b", 5, False, "x"), ("c", 1, False, "y"), ("c", 1, False, "w")),
    ]
    emitted = []
    for made in batches:
        put(rocks, source, made)
        lww.into_changes(rocks.readStream.schema(SCHEMA).parquet(source), out, checkpoint).awaitTermination()
        emitted.append(rocks.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(out).count())
    every = rocks.createDataFrame([r for made in batches for r in made], SCHEMA)
    got = lww.winners(rocks, out, every.schema).orderBy("subject_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in latest(every).orderBy("subject_id").collect()]
    assert [r.title for r in got] == ["a 2 x", "b 5 x", "c 1 y"]
    assert emitted == [2, 4, 5]  # c's first row, a's tombstone; then c's alone


def test_a_supervised_subscription(spark, tmp_path):
    """The source isn't there at first, then holds a broken file; each time it is tried again after its delay."""
    source, out, checkpoint = (tmp_path / n for n in ("in", "out", "checkpoint"))
    waits = []

    def start():
        return lww.into_snapshots(spark.readStream.schema(SCHEMA).parquet(str(source)), str(out), str(checkpoint))

    def wait(seconds):
        waits.append(seconds)
        if len(waits) == 1:
            source.mkdir()
            (source / "broken.parquet").write_bytes(b"PAR1 not at all")
        else:
            (source / "broken.parquet").unlink()
            checkpoint_files = list(checkpoint.rglob("*"))
            assert checkpoint_files
            put(spark, str(source), rows(("a", 1, False, "x")))
            spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")

    try:
        run = lww.supervised(start, wait=wait)
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert waits == [lww.NOT_FOUND_S, lww.ERROR_S]
    schema = spark.createDataFrame([], SCHEMA).schema
    assert [r.title for r in lww.last_snapshot(run, spark, str(out), schema).collect()] == ["a 1 x"]
    with pytest.raises(Exception):
        lww.supervised(lambda: (_ for _ in ()).throw(ValueError("no")), tries=2, wait=waits.append)
    assert waits[2:] == [lww.ERROR_S]


def test_a_refused_delta_is_set_aside(spark, tmp_path):
    from tidemark.operators.merge import State

    source, refused, checkpoint = (str(tmp_path / n) for n in ("in", "refused", "checkpoint"))
    none = spark.createDataFrame([], SCHEMA)
    kept = {}

    def apply(state, delta):
        if not delta.records.where("version < 1").isEmpty():
            raise Rejected("version")
        return delta

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        lww.into_states(stream, lambda: State(none, none, none), lambda s: kept.update({r.subject_id: r.version for r in s.records.collect()}), apply, checkpoint, refused).awaitTermination()

    for made in (rows(("a", 1, False, "x")), rows(("a", 0, False, "x"), ("b", 1, False, "x")), rows(("c", 1, False, "x"))):
        put(spark, source, made)
        run()
    assert kept == {"a": 1, "c": 1}
    assert sorted((r.subject_id, r.reason) for r in spark.read.parquet(refused).collect()) == [("a", "version"), ("b", "version")]
    assert spark.read.parquet(refused).select(F.count_distinct("batch")).first()[0] == 1


def test_a_table_of_many_files_is_streamed(spark, sf_dir, tmp_path):
    """A table may be one file or a folder of files; both give the winners of all its rows."""
    from tidemark.plans import shop

    spark.read.parquet(f"{sf_dir}/client_changes.parquet").repartition(3).write.parquet(str(tmp_path / "client_changes.parquet"))
    found = [sorted(map(tuple, shop.stream_client_changes(spark, d).collect())) for d in (sf_dir, str(tmp_path))]
    assert found[0] == found[1] and len(found[0]) > 100
