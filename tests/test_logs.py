"""Logs that grow: half lines, restarts, pieces, a file that begins anew."""

import random

import pytest

from sunfold.sources import logs
from sunfold.streaming import monitor


def test_a_growing_log_is_read_once(spark, tmp_path):
    folder = tmp_path / "runs" / "one"
    folder.mkdir(parents=True)
    file = folder / "experiment.log"

    def go(text, mode="a", name=file):
        with open(name, mode, newline="") as f:
            f.write(text)
        q = monitor.training_log(spark, str(tmp_path / "runs")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[1:] for r in spark.read.parquet(str(tmp_path / "out")).select("file", "epoch", "loss").collect())

    assert go("Epoch 1/9 Loss: 0.5\nEpoch 2/9 Lo") == [(1, 0.5)]
    assert go("ss: 0.25\n") == [(1, 0.5), (2, 0.25)]
    assert go("nothing\nEpoch 3/9 Loss: 0.125\r\n") == [(1, 0.5), (2, 0.25), (3, 0.125)]
    other = folder / "b.log"
    assert go("Epoch 7 loss 1e-3\n", name=other)[-1] == (7, 0.001)
    assert len(go("")) == 4
    assert go("Epoch 8 loss 2\n", mode="w")[-1] == (8, 2.0)  # shorter than before: a new log of that name


@pytest.mark.parametrize("piece", [1, 7, 64, 10_000])
def test_pieces_have_every_line_once(tmp_path, piece):
    rng = random.Random(piece)
    lines = ["".join(rng.choice("abé\t ") for _ in range(rng.randrange(12))) for _ in range(100)]
    file = tmp_path / "x.log"
    file.write_bytes(("\n".join(lines) + "\nhalf").encode())
    reader = logs.LogReader(str(tmp_path), "*.log", piece)
    end = reader.latestOffset()
    assert end == {str(file): len(("\n".join(lines) + "\n").encode())}
    got = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert [v for _, _, v in got] == lines and sorted({a for _, a, _ in got}) == [a for _, a, _ in got]
    low = got[50][1]
    assert [v for p in reader.partitions({str(file): low}, end) for _, _, v in reader.read(p)] == lines[50:]
    assert reader.partitions(end, end) == [] and logs.LogReader(str(tmp_path / "none"), "*", 9).latestOffset() == {}
