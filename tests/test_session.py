"""What is written for the moment goes when it should, and no sooner."""

import os

from evidentia.session import release, saved, scratch


def test_scratch_keeps_what_it_is_told(spark):
    with scratch() as outer:
        a = outer(saved(spark.range(3)))
        with scratch() as inner:
            b, c = saved(spark.range(4)), inner(saved(spark.range(5)))
            assert b.count() == 4
        assert not os.path.exists(b._folder) and os.path.exists(c._folder)
    assert os.path.exists(a._folder) and not os.path.exists(c._folder)
    folder = a._folder
    release(a)
    release(a)
    release(spark.range(1))
    assert not os.path.exists(folder)
