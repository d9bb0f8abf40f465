"""Tables of the shared store belong to the thread that wrote them."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from lexloom import storage


def test_two_threads_sweep_apart(spark):
    both = Barrier(2, timeout=60)

    def job(n):
        first = storage.mark()
        held = storage.stored(spark.range(n), "held")
        both.wait()  # each has its mark and a table
        for k in range(3):
            begin = storage.mark()
            step = storage.stored(held.selectExpr(f"id + {k} AS id"), "step")
            total = step.count()
            storage.sweep(spark, begin)
            both.wait()
        left = held.count()
        storage.sweep(spark, first)
        return total, left, storage.mark() == first

    storage.shared_dir(spark)
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(job, (5, 9))) == [(5, 5, True), (9, 9, True)]
