"""Tables in the shared folder: who owns them, and the setting that deletes shuffle files."""

import os
from concurrent.futures import ThreadPoolExecutor

from plumbline import shared

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def there(df):
    return all(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())


def test_tables_go_with_their_block(spark):
    with shared.scratch(spark):
        with shared.scratch(spark):
            inner, held = shared.written(spark.range(3), "inner"), shared.written(spark.range(3), "held", hold=True)
            assert there(inner) and there(held)
        assert not there(inner) and there(held) and held.count() == 3
    assert not there(held)
    left = shared.written(spark.range(2), "left")
    assert left.count() == 2


def test_blocks_of_other_threads_are_their_own(spark):
    with shared.scratch(spark) as own, ThreadPoolExecutor(1) as pool:
        other = pool.submit(shared.written, spark.range(2), "other").result()
        assert own == []
    assert other.count() == 2


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(KEY, None)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: shared.written(spark.range(10).groupBy("id").count(), f"t{i}").count(), range(8)))
    assert spark.conf.get(KEY, None) == before and not shared._DELETING
