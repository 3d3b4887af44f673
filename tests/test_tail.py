"""A store's file as a stream."""

import json

import pytest

from engrama.sources.tail import tail


def drain(spark, path, checkpoint, out, split=16 << 20):
    q = tail(spark, str(path), split).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r["place"], r["value"], r["bad"]) for r in spark.read.parquet(str(out)).collect())


@pytest.mark.parametrize("split", [7, 16 << 20])
def test_each_line_comes_once(spark, tmp_path, split):
    """Over restarts; a cut line waits until it is whole, bad lines are marked, and parts of any size cut no line."""
    path, args = tmp_path / "s.jsonl", (tmp_path / "c", tmp_path / "o", split)
    lines = [json.dumps({"id": i, "text": "é" * i}, ensure_ascii=False) for i in range(20)]
    path.write_text("\n".join(lines[:8]) + "\n\n" + "no json\n[1]\n" + lines[8][:5])
    first = drain(spark, path, *args)
    assert [v for _, v, bad in first if not bad] == lines[:8] and [v for _, v, bad in first if bad] == ["no json", "[1]"]
    with path.open("a") as f:
        f.write(lines[8][5:] + "\n" + "\n".join(lines[9:]))
    second = drain(spark, path, *args)
    assert [v for _, v, bad in second if not bad] == lines[:19]  # the last one has no end yet
    with path.open("a") as f:
        f.write("\n")
    third = drain(spark, path, *args)
    assert [v for _, v, bad in third if not bad] == lines and len({p for p, _, _ in third}) == len(third)
    raw = path.read_bytes()
    assert all(raw[p:].startswith(v.encode()) for p, v, _ in third)


def test_folders_and_missing_files(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": 1}\n')
    (folder / ".hidden").write_text('{"id": 0}\n')
    assert [v for _, v, _ in drain(spark, folder, tmp_path / "c", tmp_path / "o")] == ['{"id": 1}']
    (folder / "b.jsonl").write_text('{"id": 2}\r\n')
    assert sorted(v for _, v, _ in drain(spark, folder, tmp_path / "c", tmp_path / "o")) == ['{"id": 1}', '{"id": 2}']
