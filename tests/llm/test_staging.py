"""Staged tables: what is deleted, and by whom."""

import os
import threading

from hirelake.llm import shared


def test_only_what_was_staged_here_is_deleted(spark):
    root = shared.shared_folder(spark)
    given = f"{root}/given"
    spark.range(5).write.mode("overwrite").parquet(f"{given}/documents.parquet")
    spark.range(6).write.mode("overwrite").parquet(f"{given}/other.parquet")
    table = spark.read.parquet(f"{given}/documents.parquet")
    shared.discard(table)
    assert table.count() == 5 and spark.read.parquet(f"{given}/other.parquet").count() == 6
    mine = shared.staged(table, "mine")
    folder = mine.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    shared.discard(mine, table)
    assert not os.path.exists(folder) and table.count() == 5


def test_scopes_of_two_threads_do_not_meet(spark):
    inside, done, kept = threading.Event(), threading.Event(), []

    def first():
        with shared.scratch(spark):
            kept.append(shared.staged(spark.range(3), "first"))
            inside.set()
            done.wait(60)
            kept.append(kept[0].count())

    thread = threading.Thread(target=first)
    thread.start()
    assert inside.wait(60)
    with shared.scratch(spark):
        mine = shared.staged(spark.range(4), "second")
        assert mine.count() == 4
    done.set()
    thread.join()
    assert kept[1] == 3 and shared._scopes() == []
