"""Helpers that the operators share."""

from types import SimpleNamespace

import pytest

from lodestream.llm import common


def session(master, **settings):
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_shared_folders(tmp_path):
    assert common.shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})).startswith("hdfs://x/y/lodestream-")
    for master in ("local", "local[*]", "local[4,2]"):
        one = session(master)
        first, second = common.shared_dir(one), common.shared_dir(one)
        assert first != second and first.rpartition("/")[0] == second.rpartition("/")[0]
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_memory_forgets_what_was_not_asked_for():
    memory, asked = common.Memory(40 * (common.Memory.ENTRY + 8)), []

    def learn(keys):
        asked.extend(keys)
        return [k.encode() for k in keys]

    for n in range(200):
        assert memory.lookup(["hot", f"k{n:03d}"], learn) == [b"hot", f"k{n:03d}".encode()]
    assert asked.count("hot") == 1 and len(memory.young) + len(memory.old) <= 42
    long = "x" * (memory.LONGEST + 1)
    assert memory.lookup([long], learn) == memory.lookup([long], learn) == [long.encode()] and asked.count(long) == 2


def test_small_tables_are_broadcast(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(common.small(spark.range(10))).lower()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 9)
    assert "broadcast" not in plan(common.small(spark.range(10))).lower()
