"""Sources and sinks: CSV catalog load with a missing source, IDX decode,
flat CSV sink, parquet round trip, result store, streaming scoring."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.operators import models as M
from catalog_engine.operators import training as TR
from catalog_engine.sources import files, images
from catalog_engine.streaming import scoring


def test_csv_sources_skip_missing(spark, tmp_path):
    p = tmp_path / "cat.csv"
    p.write_text("ProductID,ProductName,ProductBrand,Gender,Price (INR),NumImages,Description,PrimaryColor\n"
                 "1,Red Tee,Acme,Men,499.0,3,x,Red\n"
                 "2,Blue Tee,Acme,Male,1500.0,2,y,\n"
                 "3,Gold Ring,Lux,Female,2500.0,5,z,Gold\n")
    specs = [files.SourceSpec("base", str(p)), files.SourceSpec("absent", str(tmp_path / "nope.csv"))]
    df, report = files.load_sources(spark, specs, harmonise={"Male": "Men", "Female": "Women"})
    rows = sorted((r.ProductName, r.Gender, r.PriceCategory) for r in df.collect())
    assert rows == [("Gold Ring", "Women", "High"), ("Red Tee", "Men", "Low")]   # null colour dropped
    rep = {r.source: r.status for r in report.collect()}
    assert rep == {"base": "loaded", "absent": "skipped"}
    with pytest.raises(FileNotFoundError):
        files.load_sources(spark, [files.SourceSpec("absent", str(tmp_path / "nope.csv"))])


COMMON = [S.PRODUCT_ID, S.NAME, S.BRAND, S.GENDER, S.COLOR, S.PRICE, S.IMAGES, S.SOURCE, S.TIER]


def test_csv_columns_by_header_and_bad_cells(spark, tmp_path):
    p = tmp_path / "cat.csv"
    p.write_text("PrimaryColor,Price (INR),Gender,ProductName,ProductID,NumImages\n"
                 "Red,499.0,Men,Red Tee,1,3\n"
                 "Blue,cheap,Men,Blue Tee,2,3\n"
                 "Gold,,Women,Gold Ring,3,2\n")
    df, report = files.load_sources(spark, [files.SourceSpec("base", str(p))])
    rows = sorted(tuple(r) for r in df.select(S.PRODUCT_ID, S.NAME, S.PRICE, S.TIER, S.BRAND).collect())
    assert rows == [("base:1", "Red Tee", 499.0, "Low", None), ("base:3", "Gold Ring", None, "High", None)]
    assert report.first().message == "1 unreadable rows left out"
    q = tmp_path / "noprice.csv"
    q.write_text("ProductID,ProductName\n1,x\n")
    with pytest.raises(FileNotFoundError, match="no column Price"):
        files.load_sources(spark, [files.SourceSpec("base", str(q))])


def _three_retailers(spark, tmp_path):
    specs = []
    for k, (name, names) in enumerate([("first", ["product_name", "brand", "gender", "color", "price"]),
                                       ("second", ["name", "brand", "gender", "colour", "price"]),
                                       ("third", ["title", "maker", "sex", "hue", "cost"])]):
        path = tmp_path / f"{name}.csv"
        lines = [",".join(["code", *names])]
        for i in range(60):
            tier = i % 3
            lines.append(f"X{i},{['Basic', 'Fine', 'Luxury'][tier]} item,B{tier},{['Male', 'Women'][i % 2]},Red,{[20, 100, 400][tier] + k}")
        path.write_text("\n".join(lines) + "\n")
        common = [S.NAME, S.BRAND, S.GENDER, S.COLOR, S.PRICE]
        specs.append(files.retailer(name, str(path), dict(zip(common, names, strict=True)), "code"))
    return files.load_sources(spark, specs, harmonise={"Male": "Men"})


def test_three_retailers_load_and_train(spark, tmp_path):
    df, report = _three_retailers(spark, tmp_path)
    df = df.select(*COMMON)
    assert report.filter("status = 'loaded'").count() == 3
    assert df.count() == 180 and df.select(S.PRODUCT_ID).distinct().count() == 180
    assert {(r[S.TIER], r["count"]) for r in df.groupBy(S.TIER).count().collect()} == {("Low", 60), ("Medium", 60), ("High", 60)}
    assert {r[S.IMAGES] for r in df.collect()} == {1} and {r[S.GENDER] for r in df.collect()} == {"Men", "Women"}
    train, test = TR.split(df)
    model = M.build_pipeline(M.spec("text_lr")).fit(train.withColumn("label_idx", F.when(F.col(S.TIER) == "Low", 0.0).when(F.col(S.TIER) == "Medium", 1.0).otherwise(2.0)))
    scored = model.transform(test.withColumn("label_idx", F.lit(0.0)))
    assert scored.count() == test.count() > 0


def _idx(path, n, rows, cols, labels):
    pix = (np.arange(n * rows * cols) % 256).astype(np.uint8)
    with gzip.open(path + "-images-idx3-ubyte.gz", "wb") as f:
        f.write(struct.pack(">IIII", 2051, n, rows, cols) + pix.tobytes())
    with gzip.open(path + "-labels-idx1-ubyte.gz", "wb") as f:
        f.write(struct.pack(">II", 2049, n) + bytes(labels))
    return pix.reshape(n, rows * cols)


def test_idx_decode_and_sinks(spark, tmp_path):
    d = tmp_path / "idx"
    d.mkdir()
    pix = _idx(str(d / "train"), 5, 2, 3, [1, 2, 3, 4, 5])
    df = images.read_idx(spark, str(d), partitions=2)
    rows = sorted(df.collect(), key=lambda r: int(r.image_id.split(':')[1]))
    assert [r.label for r in rows] == [1, 2, 3, 4, 5]
    assert [list(r.pixels) for r in rows] == pix.astype(float).tolist()
    scaled = images.scale_pixels(df).agg(F.max(F.array_max("pixels"))).first()[0]
    assert scaled == pytest.approx(29 / 255.0)
    images.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 5
    images.write_flat_csv(df, str(tmp_path / "csv"), n_pixels=6)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["label", "0", "1", "2", "3", "4", "5"]
    named = images.with_class_names(df).select("class_name").distinct().count()
    assert named == 5


def test_result_store(spark, tmp_path):
    m = spark.createDataFrame([(0.5, 10)], "accuracy double, n long")
    files.store_results(m, str(tmp_path), "r1", "metrics")
    files.store_results(m.withColumn("n", F.lit(20).cast("long")), str(tmp_path), "r2", "metrics")
    assert files.read_results(spark, str(tmp_path), "metrics", "r2").first().n == 20
    files.store_results(m, str(tmp_path), "r1", "metrics")  # again: replaced, not doubled
    assert files.read_results(spark, str(tmp_path), "metrics").count() == 2


def test_streaming_scoring_equals_batch(spark, tmp_path):
    rows = [(i, f"item {i % 4}", f"b{i % 3}", "Men", "Black", i % 10) for i in range(60)]
    schema = (f"{S.PRODUCT_ID} long, {S.NAME} string, {S.BRAND} string, {S.GENDER} string, "
              f"{S.COLOR} string, {S.IMAGES} int")
    df = spark.createDataFrame(rows, schema)
    train = M.tier_label(df.withColumn(S.TIER, F.when(F.col(S.IMAGES) < 4, "Low")
                                       .when(F.col(S.IMAGES) < 7, "Medium").otherwise("High")))
    model = TR.fit(train, "RandomForest", n_trees=5, max_depth=3)
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = scoring.start_scoring(spark, model, src, df.schema, str(tmp_path / "out"),
                              "RandomForest__", checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = M.as_predictions(model.transform(train), "RandomForest__")
    got = {r[S.PRODUCT_ID]: r.prediction for r in out.collect()}
    want = {r[S.PRODUCT_ID]: r.prediction for r in batch.collect()}
    assert got == want
