"""What workers keep after a task, and an operator on disk."""

import os

import psutil

from kinmatch.llm import substring_dedup
from kinmatch.llm.common import CLEANUP, lean


def test_freed_memory_goes_back():
    def run(batches):
        held = [bytearray(100_000) for _ in range(3000)]
        pin = bytearray(100_000)  # above the others, so that the heap's end can't go back
        del held
        yield from batches
        yield pin

    used = lambda: psutil.Process().memory_info().rss / 1e6
    before = used()
    got = list(lean(run)([1, 2]))
    assert got[:2] == [1, 2] and used() - before < 150


def test_substring_dedup_removes_what_it_has_used(spark, docs, tmp_path):
    """What is left on disk once the operator returns is what its result reads."""
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    files = sc._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {x for x in (found.apply(k).getName() for k in range(found.size())) if x.startswith("shuffle_")}

    broadcasts = lambda: set(os.listdir(sc._temp_dir))
    setting = spark.conf.get(CLEANUP, None)
    sc.setCheckpointDir(str(tmp_path))
    had_shuffles, had_broadcasts = shuffles(), broadcasts()
    try:
        found = substring_dedup.deduplicate(docs)
        (own,) = tmp_path.iterdir()
        tables = [p for p in own.iterdir() if any(p.glob("*.parquet"))]
        assert len(tables) == 1 and "removed" in spark.read.parquet(str(tables[0])).columns
        assert not shuffles() - had_shuffles and not broadcasts() - had_broadcasts
        assert spark.conf.get(CLEANUP, None) == setting
        assert sum(x.n_removed_words > 0 for x in found.collect()) > 3
    finally:
        if before:
            sc.setCheckpointDir(before)
