"""Chunked runs: the same rows as in one go, and no chunk twice after a kill."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import chunked as C


def sums(df):
    return df.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


class Counted:
    """Counts its calls and stops at the one that it is told to."""

    def __init__(self, stop_at=None, after_rows=False):
        self.calls, self.stop_at = 0, stop_at

    def __call__(self, df):
        self.calls += 1
        if self.calls == self.stop_at:
            raise KeyboardInterrupt
        return sums(df)


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.when(F.col("id") != 1, F.col("id") % 40)).alias("k"), F.col("id").alias("v"))


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_rows_as_in_one_go(spark, source, tmp_path):
    got = C.run_chunked(source, "k", sums, str(tmp_path / "run"), 5)
    assert plain(got) == plain(sums(source))
    log = C.journal(spark, str(tmp_path / "run")).collect()
    assert [r["status"] for r in log] == ["done"] * 5 and sum(r["n"] for r in log) == got.count()


def test_kill_and_resume(spark, source, tmp_path):
    path = str(tmp_path / "run")
    killed = Counted(stop_at=3)
    with pytest.raises(KeyboardInterrupt):
        C.run_chunked(source, "k", killed, path, 5)
    assert [r["status"] for r in C.journal(spark, path).collect()] == ["done", "done", "open", "open", "open"]
    partly = plain(C.chunk_rows(spark, path))
    again = Counted()
    whole = plain(C.run_chunked(source, "k", again, path, 5))
    assert again.calls == 3 and whole == plain(sums(source)) and set(partly) < set(whole)
    steps = list(C.chunk_steps(source, "k", again, path, 5))
    assert again.calls == 3 and {e.source for e in steps} == {"resumed"}


def test_what_is_not_whole_is_computed_again(spark, source, tmp_path):
    path = tmp_path / "run"
    C.run_chunked(source, "k", sums, str(path), 4)
    (path / "journal" / "chunk-00001.json").write_text('{"chunk": 1, "n"')  # cut off
    (path / "journal" / ".chunk-00001.json.crc").unlink(missing_ok=True)
    (path / "rows" / "chunk=2" / "_SUCCESS").unlink()  # rows without their mark
    again = Counted()
    assert plain(C.run_chunked(source, "k", again, str(path), 4)) == plain(sums(source))
    assert again.calls == 2


def test_another_input_or_version_starts_afresh(source, tmp_path):
    path = str(tmp_path / "run")
    C.run_chunked(source, "k", sums, path, 3)
    for df, chunks, version in ((source.filter("v < 400"), 3, "1"), (source.filter("v < 400"), 4, "1"), (source.filter("v < 400"), 4, "2")):
        again = Counted()
        assert plain(C.run_chunked(df, "k", again, path, chunks, version)) == plain(sums(df))
        assert again.calls == chunks
    assert Path(path, "manifest.json").exists()


def test_empty_chunks_and_input(spark, source, tmp_path):
    one = source.filter("k = 7")
    assert plain(C.run_chunked(one, "k", sums, str(tmp_path / "one"), 6)) == plain(sums(one))
    none = source.filter("v < 0")
    assert C.run_chunked(none, "k", sums, str(tmp_path / "none"), 2).count() == 0
    with pytest.raises(ValueError, match="one chunk"):
        C.run_chunked(source, "k", sums, str(tmp_path / "x"), 0)
