"""Scratch tables on a local disk are written without a process for each file."""

import pathlib

import numpy as np

from geoshroud.llm import ngram_join
from geoshroud.llm.scratch import Scratch


def test_no_file_starts_a_process(spark):
    scratch = Scratch(spark, "test")
    root = pathlib.Path(scratch.root.removeprefix("file:"))
    kept = scratch.keep(spark.range(20, numPartitions=4), "ids")
    keyed = scratch.append_keyed(kept, "plain_files", "id")
    keyed = scratch.append_keyed(spark.range(20, 30), "plain_files", "id")
    assert kept.count() == 20 and keyed.count() == 30
    assert list(root.rglob("*.parquet")) and not list(root.rglob("*.crc"))  # only the file system that starts chmod writes these
    scratch.drop(kept)
    scratch.drop_keyed("plain_files")
    assert not list(root.rglob("*.parquet"))


def test_shingles_are_counted_in_place():
    tok = np.array([5, 1, 5, 2, 1, 5, 9, 1, 1], np.int64)
    often, times = ngram_join._counted(tok)
    assert dict(zip(often.to_pylist(), times.to_pylist())) == {1: 4, 5: 3}
    assert tok.tolist() == [1, 1, 1, 1, 2, 5, 5, 5, 9]  # the buffer itself is sorted: no second one is made
    assert [len(x) for x in ngram_join._counted(tok[:1])] == [0, 0]
