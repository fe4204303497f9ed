"""Hashes, code points and scratch space that the corpus operators share."""

import numpy as np
import pytest
from arborel.llm import common


def test_hashes_of_slices():
    """Equal slices have equal hashes and unlike ones unlike, short and long; windows are slices."""
    own = np.random.default_rng(1)
    buf = own.integers(97, 100, 3000).astype(np.uint8)
    roll = common.RollingHash(buf)
    for size in (1, 3, 7, 8, 9, 30):
        found = roll.windows(size)
        at = np.arange(len(found))
        assert len(found) == len(buf) - size + 1 and (roll.slices(at, at + size) == found).all()
        by_bytes = {}
        for k in range(len(found)):
            by_bytes.setdefault(buf[k : k + size].tobytes(), set()).add(int(found[k]))
        assert all(len(x) == 1 for x in by_bytes.values()) and len({min(x) for x in by_bytes.values()}) == len(by_bytes)


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_words_that_mirror_each_other(size):
    word = np.array([97 + (k.bit_count() & 1) for k in range(size)], dtype=np.uint8)
    roll = common.RollingHash(np.concatenate((word, np.uint8(195) - word)))
    first, second = roll.slices(np.array([0, size]), np.array([size, 2 * size]))
    assert first != second


def test_code_points():
    text = "aé日🎉x́ ߿ࠀ￿\U00010000"
    found, at = common.points(np.frombuffer(text.encode(), np.uint8))
    assert "".join(map(chr, found)) == text and at.tolist() == [len(text[:k].encode()) for k in range(len(text))]


def test_names_that_no_column_has():
    assert common.unlike(["a", "KEY", "key_"], "key") == "key__" and common.unlike([], "x") == "x"


def test_shared_folder_only_on_one_machine(spark, monkeypatch):
    """Without spark.checkpoint.dir a session on one machine makes a folder of its own, and a cluster raises."""

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return Context._jsc

            @staticmethod
            def isDefined():
                return False

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    assert common.shared_dir(spark)


def test_batches_are_bound_by_bytes(spark):
    docs = spark.range(200).selectExpr("repeat('x', 1000000) AS text").coalesce(1)
    before = spark.conf.get(common.BATCH)
    sizes = [r["b"] for r in common.mapped(docs, lambda batches: (_size(x) for x in batches), "b long").collect()]
    assert len(sizes) > 10 and max(sizes) < 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH, "1m")
    common.mapped(docs, lambda batches: (_size(x) for x in batches), "b long")
    assert spark.conf.get(common.BATCH) == "1m"
    spark.conf.set(common.BATCH, before)


def _size(batch):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["b"])
