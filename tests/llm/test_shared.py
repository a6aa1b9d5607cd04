from __future__ import annotations

import os

from memloom.llm.shared import drop, materialize


def test_superseded_tables_are_deleted(spark):
    tables = [materialize(spark.range(n), "some") for n in (1, 2, 3)]
    paths = [os.path.dirname(t.inputFiles()[0].removeprefix("file://")) for t in tables]
    drop(tables[1])
    assert [os.path.exists(p) for p in paths] == [True, False, True]
    drop(spark.range(1))
    assert tables[0].count() == 1 and tables[2].count() == 3
