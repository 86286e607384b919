"""Array files, pairs of parties, exact distinct counts, samples, dates, left factors and errors over a stream."""

import datetime
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import prepare as P
from quern.operators import decompose as D
from quern.operators import factorize as Z
from quern.plans import catalog
from quern.sources import readers
from quern.streaming.scoring import windowed_error


def test_array_files_round_trip(spark, tmp_path):
    a, b = np.arange(12.0).reshape(4, 3), np.arange(8, dtype=np.int16).reshape(2, 2, 2)
    np.savez(tmp_path / "two.npz", a=a, b=b)
    np.savez_compressed(tmp_path / "odd.npz", text=np.array(["x", "y"]), none=np.zeros((0, 3)), one=np.float32(2.5), flags=np.array([True, False]))
    np.save(tmp_path / "plain.npy", np.arange(9000.0))
    np.save(tmp_path / "pickled.npy", np.array([{"a": 1}], object), allow_pickle=True)
    (tmp_path / "torn.npz").write_bytes((tmp_path / "two.npz").read_bytes()[:120])
    with zipfile.ZipFile(tmp_path / "mixed.npz", "w") as z:
        z.writestr("good.npy", (tmp_path / "plain.npy").read_bytes()[: 128 + 8 * 9000])
        z.writestr("bad.npy", b"\x93NUMPY not really")
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "other.txt").write_text("left out")
    rows = readers.read_arrays(spark, str(tmp_path)).collect()
    found = {}
    for r in rows:
        found.setdefault((r["path"].rsplit("/", 1)[-1], r["member"]), []).append(r)
    values = lambda *key: np.array([r["values"] for r in sorted(found[key], key=lambda r: r["row"])])
    assert (values("two.npz", "a") == a).all() and (values("two.npz", "b") == b.reshape(2, 4)).all()
    assert (values("plain.npy", "plain")[:, 0] == np.arange(9000)).all() and (values("mixed.npz", "good")[:, 0] == np.arange(9000)).all()
    assert values("odd.npz", "one").tolist() == [[2.5]] and values("odd.npz", "flags").tolist() == [[1.0], [0.0]] and ("odd.npz", "none") not in found
    for key in (("odd.npz", "text"), ("pickled.npy", "pickled"), ("torn.npz", None), ("mixed.npz", "bad")):
        (r,) = found[key]
        assert r["values"] is None and r["row"] is None and r["error"]
    assert readers.read_binary(spark, str(tmp_path), "*.txt").select("length").first()[0] == 8


def test_last_rows_of_the_same_two_parties(spark):
    rng = np.random.default_rng(6)
    games = [(i, int(rng.integers(0, 40)), *map(int, rng.integers(0, 4, 2)), *map(float, rng.integers(0, 5, 2))) for i in range(120)]
    df = spark.createDataFrame(games, "id int, day int, home int, away int, hg double, ag double").repartition(4)
    got = {r["id"]: (r["home_sum"], r["away_sum"], r["n"]) for r in P.last_against_each_other(df, ["home", "away"], ["hg", "ag"], "day", "id", 3).collect()}
    for i, day, home, away, _, _ in games:
        before = sorted((g for g in games if {g[2], g[3]} == {home, away} and (g[1], g[0]) < (day, i)), key=lambda g: (g[1], g[0]))[-3:]
        goals = lambda team, first: sum((g[4] if first else g[5]) if home == away else g[4] if g[2] == team else g[5] for g in before)
        want = (goals(home, True), goals(away, False), len(before)) if before else (None, None, 0)
        assert got[i] == want


def test_counts_samples_and_dates(spark):
    df = spark.createDataFrame([(i, float(i % 3), None, "x" if i % 2 else None) for i in range(50)], "a int, b double, c string, d string").repartition(3)
    assert {r["name"]: r["n"] for r in P.distinct_counts(df, ["a", "b", "c", "d"]).collect()} == {"a": 50, "b": 3, "c": 0, "d": 1}
    assert P.split_kinds(df, ["a", "b", "c", "d"], most=10) == (["a"], ["b"]) == P.split_kinds(df, ["a", "b", "d"], most=10, exact=False)
    assert P.sampled(df, 7).distinct().count() == 7 and P.sampled(df, 70).count() == 50
    one = df.limit(1).select(P.date_text(F.lit(0)).alias("x"), P.date_text(F.lit(1_700_000_000), "yyyy-MM-dd HH:mm", "Asia/Tokyo").alias("y")).first()
    assert one["x"] == "1970-01-01" and one["y"] == "2023-11-15 07:13"
    train, other = P.standardized(df, [df.where("a < 5")], ["a", "b"])
    assert abs(train.agg(F.avg("a")).first()[0]) < 1e-12 and other.agg(F.min("a")).first()[0] == pytest.approx(train.agg(F.min("a")).first()[0])


def test_left_factors_and_their_signs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    x[:, 2] = x[:, 0] - x[:, 1]  # the third singular value is 0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double").repartition(3)
    u, m = D.left_factors(df, "i", D.truncated_svd(df, ["a", "b", "c"], 2))
    got = np.array([tuple(r)[1:] for r in u.orderBy("i").collect()])
    assert np.allclose(got * m.singular_values @ m.components, x, atol=1e-8) and np.allclose(got.T @ got, np.eye(2), atol=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in got.T)
    fitted = D.truncated_svd(df, ["a", "b", "c"], 3)
    fitted.singular_values[2] = 0.0
    assert D.left_factors(df, "i", fitted)[0].agg(F.sum(F.abs("u2"))).first()[0] == 0


@pytest.fixture
def split_without_rows(spark, tmp_path):
    """A folder of embeddings in one file that is read in more splits than it has groups of rows; the vectors."""
    x = np.random.default_rng(4).normal(size=(90, 64)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("6000", "0")):
        spark.conf.set(k, v)
    assert 0 in spark.read.parquet(f"{tmp_path}/embeddings.parquet").rdd.glom().map(len).collect()
    yield str(tmp_path), x.astype(float)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_principal_components_of_splits_without_rows(spark, split_without_rows):
    folder, x = split_without_rows
    got = np.array([tuple(r)[1:] for r in catalog.QUERIES["pca_embeddings"](spark, folder).orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-8)


def test_variances_of_components_of_splits_without_rows(spark, split_without_rows):
    got = {(r["i"], r["j"]): r["value"] for r in catalog.QUERIES["pca_orthogonality"](spark, split_without_rows[0]).collect()}
    assert got == {(i, j): float(i == j) for i in range(4) for j in range(i, 4)}


def test_products_of_directions_of_splits_without_rows(spark, split_without_rows):
    got = {(r["i"], r["j"]): r["value"] for r in catalog.QUERIES["svd_orthogonality"](spark, split_without_rows[0]).collect()}
    assert got == {(i, j): float(i == j) for i in range(4) for j in range(i, 4)}


def test_truncated_directions_of_splits_without_rows(spark, split_without_rows):
    folder, x = split_without_rows
    got = np.array([tuple(r)[1:] for r in catalog.QUERIES["truncated_svd_embeddings"](spark, folder).orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-8)


def test_errors_over_windows_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=m), float(y), float(p)) for m, y, p in [(0, 1, 2), (3, 2, 2), (12, 5, 1), (14, 1, 1), (60, 0, 0)]]
    more = [(start + datetime.timedelta(minutes=61), 0.0, 0.0)]
    late = [(start + datetime.timedelta(minutes=1), 9.0, 0.0), (start + datetime.timedelta(minutes=120), 0.0, 0.0)]
    kind = "at timestamp, y double, p double"
    for k, batch in enumerate((rows, more, late)):  # a batch drops what was late when the one before it began
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for part in (tmp_path / f"in/{k}").glob("part-*"):
            os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = windowed_error(stream, "at", "y", "p").writeStream.format("memory").queryName("errors").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    got = {r["start"]: (r["n"], r["rmse"]) for r in spark.table("errors").collect()}
    assert got[start] == (2, pytest.approx(0.5**0.5)) and got[start + datetime.timedelta(minutes=10)] == (2, pytest.approx(8**0.5))


def test_ratings_of_files_in_blocks(spark, tmp_path):
    rng = np.random.default_rng(8)
    want = []
    for name in "ab":
        lines = ["7,3.0,before any heading"] if name == "a" else []
        want += [(None, 7, 3.0)] if name == "a" else []
        for item in range(60):
            lines.append(f"{item}:")
            for _ in range(int(rng.integers(0, 9))):
                user, r = int(rng.integers(0, 50)), float(rng.integers(1, 6))
                lines.append(f"{user},{r},2005-01-01")
                want.append((item, user, r))
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = readers.read_ratings(spark, str(tmp_path))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_factors_of_large_rank_and_their_errors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cells = [(int(u), int(i)) for u in range(25) for i in range(15) if rng.random() < 0.5]
    ratings = spark.createDataFrame([(u, i, float(rng.normal() + 3)) for u, i in cells], "user int, item int, r double").repartition(3)
    small = Z.alternate(ratings, "user", "item", "r", rank=3, max_iter=2)
    monkeypatch.setattr(Z, "MOST_SUMS", 0)
    wide = Z.alternate(ratings, "user", "item", "r", rank=3, max_iter=2)
    values = lambda m: {(side, r["id"]): r["features"] for side in ("users", "items") for r in getattr(m, side).collect()}
    one, two = values(small), values(wide)
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-9) for k in one)
    assert small.scores[-1][0] == pytest.approx(small.error(ratings, "r")) and [s for s, _ in wide.scores] == pytest.approx([s for s, _ in small.scores])
