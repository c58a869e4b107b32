import numpy as np

from latticework.kernels import png
from latticework.plans.config import Config
from latticework.streaming import watch


def test_folder_is_read_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    image = np.zeros((16, 16, 4), np.uint8)
    image[2:9, 2:9] = 255
    run = lambda: watch.watch_folder(spark, str(root), Config.default(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (root / "a.png").write_bytes(png.encode(image))
    run()
    (root / "b.png").write_bytes(png.encode(image))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and out.where("status = 'ok' AND size(sprites) = 1").count() == 2


def test_event_windows(spark, tmp_path):
    sf = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(sf).schema
    import shutil

    (tmp_path / "ev").mkdir()
    shutil.copy(sf, tmp_path / "ev/part.parquet")
    stream = watch.event_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")), "1 day")
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == spark.read.parquet(sf).count()
