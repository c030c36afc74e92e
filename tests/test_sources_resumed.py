"""The event-stream source under any cut of its bytes, and a provider that fails half way."""

import glob
import random

import pytest
from pyspark.errors import PySparkException

from skeinlake.operators.answers import Answers
from skeinlake.sources import event_stream as E


def body(n, seed=0):
    rng = random.Random(seed)
    frames = []
    for i in range(n):
        nl = rng.choice(["\n", "\r\n"])
        lines = [f"id: {i}"] + ([f"event: {rng.choice('ab')}"] if i % 3 else []) + [f"data: {'é' * rng.randrange(4)}{i}"] + (["data:x"] if i % 4 == 0 else []) + ([": note"] if i % 5 == 0 else [])
        frames.append(nl.join(lines) + nl * 2 if i % 7 else f": nothing{nl}{nl}")
    return "".join(frames).encode()


def expected(data):
    out, at = [], 0
    for m in E._END.finditer(data):
        if frame := E.parsed(data[at : m.start()].decode()):
            out.append((at, *frame))
        at = m.end()
    return out


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 20])
def test_stretches_meet_without_gaps(tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(E, "STRETCH", stretch)
    monkeypatch.setattr(E, "BLOCK", 5)
    data = body(40)
    rng = random.Random(stretch)
    got, at, cut = [], {"files": "{}"}, 0
    reader = E.EventStreamReader(str(tmp_path))
    while cut < len(data):
        cut = min(len(data), cut + rng.randrange(1, 90))
        (tmp_path / "a").write_bytes(data[:cut])
        if rng.random() < 0.3:
            reader = E.EventStreamReader(str(tmp_path))  # a restart knows nothing but the offset
            reader.partitions(at, at)
        end = reader.latestOffset()
        for p in reader.partitions(at, end):
            got += [r[1:] for r in reader.read(p)]
        at = end
    assert got == expected(data) and len(got) > 30


def test_stream_goes_on_after_restarts(spark, tmp_path):
    E.register(spark)
    data, other = body(30), body(12, 1)
    (tmp_path / "in").mkdir()
    for cut in (0, 100, 333, len(data)):
        (tmp_path / "in/a").write_bytes(data[:cut])
        if cut > 100:
            (tmp_path / "in/b").write_bytes(other + b"data: unfinished")
        stream = spark.readStream.format("event_stream").load(f"file://{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted([("a", *f) for f in expected(data)] + [("b", *f) for f in expected(other)])


def test_no_text_is_asked_for_twice(spark, tmp_path):
    log = str(tmp_path / "log")

    def provider(fails):
        def call(texts):
            import os
            import uuid

            os.makedirs(log, exist_ok=True)
            if fails and len(os.listdir(log)) >= 3:
                raise RuntimeError("no more")
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return call

    rows = spark.createDataFrame([(i, f"text {i % 50}" if i != 7 else None) for i in range(120)], "i int, text string").repartition(3)
    own = Answers(spark, f"file://{tmp_path}/store", "m1", buckets=4)
    with pytest.raises(PySparkException):
        own.embedded(rows, provider(True), batch=4).count()
    before = sum(len(open(f).read().split("\n")) for f in glob.glob(f"{log}/*"))
    assert before >= 12
    got = {r["i"]: r["embedding"] for r in Answers(spark, f"file://{tmp_path}/store", "m1").embedded(rows, provider(False), batch=4).collect()}
    assert got == {i: [float(len(f"text {i % 50}" if i != 7 else "")), 1.0] for i in range(120)}
    asked = [t for f in glob.glob(f"{log}/*") for t in open(f).read().split("\n")]
    assert len(asked) == len(set(asked)) == 51
    assert own.embedded(rows, provider(True)).count() == 120  # nothing is left to ask
    assert Answers(spark, f"file://{tmp_path}/store", "m2").embedded(rows.limit(2), provider(False)).count() == 2
