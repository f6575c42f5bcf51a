"""Tables that pass: deleted with their block, but for lasting ones."""

import os

import pytest

from scriptmill.session import drop_staged, passing, stage


def folder(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("//", "/")


def test_only_lasting_tables_outlive_their_block(spark):
    outer = stage(spark.range(3), "outer")
    with passing(spark):
        first = folder(stage(spark.range(3), "first"))
        with passing(spark):
            second = folder(stage(spark.range(4), "second"))
            third = stage(spark.range(5), "third", lasting=True)
        assert not os.path.exists(second) and os.path.exists(first) and third.count() == 5
        third = folder(third)
        kept = stage(spark.range(6), "kept", lasting=True)
    assert not os.path.exists(first) and not os.path.exists(third)
    assert kept.count() == 6 and outer.count() == 3


def test_a_block_that_fails_deletes_its_tables_and_those_kept_are_still_dropped(spark):
    drop_staged(spark)
    kept = folder(stage(spark.range(3), "kept"))
    with pytest.raises(ValueError), passing(spark):
        gone = folder(stage(spark.range(3), "gone"))
        raise ValueError
    assert not os.path.exists(gone) and os.path.exists(kept)
    assert drop_staged(spark) == 1 and not os.path.exists(kept)
