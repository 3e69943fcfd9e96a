"""The scan of NPY shards over ids beyond what the small tables have."""

from __future__ import annotations

from featlake.plans import registry

registry.load()


def test_rows_of_high_ids_are_kept(spark, tmp_path):
    rows = [(i, [float(i), 0.0, i / 8]) for i in (3, 99_999, 100_000, 250_000, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["global_row"], r["x"]) for r in registry.QUERIES["A06_npy_scan"](spark, str(tmp_path)).collect())
    assert got == [(k, i / 8) for k, i in enumerate(sorted(i for i, _ in rows))]


def test_slices_of_shards_written_elsewhere(spark, tmp_path):
    """Shards of another type and header version, read in slices; one that lies by columns is refused."""
    import numpy as np
    import pytest

    from featlake.sources import npy

    npy.register(spark)
    x = np.arange(60, dtype=np.float64).reshape(20, 3)
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep/a.npy", x[:13].astype(np.float16))
    with open(tmp_path / "deep/b.npy", "wb") as f:
        np.lib.format.write_array(f, x[13:], version=(2, 0))
    got = sorted(map(tuple, spark.read.format("npy").option("rows", 4).load(f"file://{tmp_path}").collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(20)) and [r[2] for r in got] == x.tolist() and {r[0] for r in got} == {"a.npy", "b.npy"}
    np.save(tmp_path / "deep/c.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="row by row"):
        spark.read.format("npy").load(str(tmp_path)).collect()
