"""What the driver holds: finished rounds and models are let go."""


def test_rounds_are_let_go(spark, monkeypatch):
    from palisade.llm import components

    calls, real = [], components.release
    monkeypatch.setattr(components, "release", lambda session: (calls.append(1), real(session)))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = components.connected_components(edges).collect()
    assert {r.component for r in got} == {0} and {r.node for r in got} == set(range(41))
    assert len(calls) >= 2


def test_model_is_let_go(spark, monkeypatch):
    from palisade.llm import quality
    from palisade.session import ship

    ship(spark)
    closed, real = [], quality.Model.close
    monkeypatch.setattr(quality.Model, "close", lambda model: (closed.append(model.n), real(model)))
    rows = [(i, f"a text of some words, number {i}, that says little more than its number {i * 7}", "en") for i in range(50)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), plain=False)
    assert got.count() == 50 and closed == [1]


def test_freed_memory_goes_back_to_the_system(spark):
    """Buffers freed outside the heap, with some still in use between them, which keep the allocator from shrinking by itself."""
    import gc
    import re
    import time
    from pathlib import Path

    import pytest

    from palisade.session import release

    jvm = spark.sparkContext._jvm
    rollup = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not rollup.exists():
        pytest.skip("not Linux")

    def mb():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read_text())[1]) / 1024

    freed, used = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for i in range(1500):
        (freed if i % 50 else used).add(jvm.java.nio.ByteBuffer.allocateDirect(100_000))
    del freed
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = mb()
    release(spark)
    assert used.size() == 30 and before - mb() > 70
