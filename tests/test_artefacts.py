"""Artefact files appear all or not at all; band-limited resampling."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import binary, signal
from tessera.sources import artefacts


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_turns_as_wav_files(spark, tmp_path):
    artefacts.register(spark)
    rows = spark.range(20).select(F.format_string("s%d/turn-%d.wav", F.col("id") % 3, "id").alias("name"), binary.wav(F.encode(F.repeat(F.lit("ab"), F.col("id").cast("int")), "UTF-8"), 16000).alias("content"))
    rows.repartition(4).write.format("artefacts").mode("append").save(str(tmp_path))
    assert files(tmp_path) == sorted(f"s{i % 3}/turn-{i}.wav" for i in range(20))
    data = (tmp_path / "s1" / "turn-4.wav").read_bytes()
    assert data[:4] == b"RIFF" and data[44:] == b"abababab"
    with pytest.raises(Exception, match="exist already"):
        rows.write.format("artefacts").mode("append").save(str(tmp_path))
    assert len(files(tmp_path)) == 20


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    artefacts.register(spark)
    bad = F.when(F.col("id") == 17, F.raise_error(F.lit("no sound"))).otherwise(F.lit("x"))
    rows = spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("name"), F.encode(bad.cast("string"), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="no sound"):
        rows.write.format("artefacts").mode("append").save(str(tmp_path))
    assert files(tmp_path) == []


class LateFile:
    """A file system on which a task's file appears while the folder is deleted for the first time."""

    def __init__(self, system):
        self.system, self.deletions = system, 0

    def __getattr__(self, name):
        return getattr(self.system, name)

    def delete_dir(self, path):
        self.deletions += 1
        if self.deletions == 1:
            self.system.create_dir(f"{path}/7")
            self.system.open_output_stream(f"{path}/7/0").close()
            raise OSError("Directory not empty")
        self.system.delete_dir(path)


def test_abort_deletes_a_file_that_comes_late(tmp_path, monkeypatch):
    writer = artefacts.ArtefactWriter({"path": str(tmp_path)}, False)
    system, base = writer._at()
    late = LateFile(system)
    monkeypatch.setattr(writer, "_at", lambda: (late, base))
    writer.abort([])
    assert late.deletions == 2 and os.listdir(tmp_path) == []


def test_names_stay_inside_and_come_once(spark, tmp_path):
    artefacts.register(spark)
    for names, message in ((["../x"], "leaves"), (["a", "a"], "come twice")):
        with pytest.raises(Exception, match=message):
            spark.createDataFrame([(n, b"1") for n in names], "name string, content binary").write.format("artefacts").mode("append").save(str(tmp_path / "in"))
    assert files(tmp_path) == []


def tone(hz, rate, seconds=0.5):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize(("rate_in", "rate_out"), [(48000, 16000), (44100, 16000), (16000, 24000), (22050, 16000)])
def test_bands(rate_in, rate_out):
    run = signal.band_limited(rate_in, rate_out).func
    size = lambda hz: (y := np.array(run(pd.Series([tone(hz, rate_in)]))[0]))[len(y) // 5 : -len(y) // 5]
    low = size(1000)
    assert abs(20 * math.log10(np.sqrt(2 * np.mean(low**2)))) < 0.05
    if rate_out < rate_in:
        for hz in (rate_out / 2 * 1.08, rate_out / 2 * 1.3):
            if hz < rate_in / 2:
                assert 20 * math.log10(np.sqrt(2 * np.mean(size(hz) ** 2)) + 1e-12) < -60
    want = np.sin(2 * np.pi * 1000 * np.arange(round(rate_in * 0.5 * rate_out / rate_in)) / rate_out)
    got = np.array(run(pd.Series([tone(1000, rate_in)]))[0])
    assert len(got) == len(want) and np.abs(got - want)[200:-200].max() < 2e-3


def test_resampling_edges():
    run = signal.band_limited(48000, 16000).func
    assert run(pd.Series([None, [], [1.0]], dtype=object)).tolist() == [None, [], pytest.approx(run(pd.Series([[1.0]]))[0])]
    assert [len(run(pd.Series([[0.5] * n]))[0]) for n in (1, 2, 3, 4, 5, 100)] == [1, 1, 1, 1, 2, 33]
    assert signal.band_limited(8000, 8000).func(pd.Series([[1.0, 2.0]]))[0] == [1.0, 2.0]
