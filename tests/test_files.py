"""Files in and out."""

import pytest

from tamarack.operators import split
from tamarack.sources import files
from tamarack.streaming import ratings as stream


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame([(1, m, 4.0, m) for m in range(10)], files.RATINGS)


def test_csv_in_two_layouts(spark, tmp_path):
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,"A, The (1999)",Drama\n2,B,\nx,C,\n')
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating\n1,1,4.5\n1,2,oops\n")
    assert [tuple(r) for r in files.read_movies(spark, str(tmp_path / "movies.csv")).collect()][:2] == [(1, "A, The (1999)", "Drama"), (2, "B", "")]
    got = files.read_ratings(spark, str(tmp_path / "ratings.csv")).collect()
    assert got[0].rating == 4.5 and got[1].rating is None and got[0].timestamp < got[1].timestamp
    assert files.read_optional(spark, str(tmp_path / "none.csv"), files.TAGS).count() == 0


def test_genome_in_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("movieId,tag,relevance\n1,dark,0.9\n1,slow,0.5\n1,weak,0.1\n")
    (tmp_path / "b.csv").write_text("movieId,tag_genome_tags\n1,dark slow\n")
    want = [(1, "dark slow")]
    assert [tuple(r) for r in files.read_tag_genome(spark, str(tmp_path / "a.csv")).collect()] == want
    assert [tuple(r) for r in files.read_tag_genome(spark, str(tmp_path / "b.csv")).collect()] == want


def test_dat(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes("1::Caf\xe9 (1999)::Drama|War\n".encode("latin-1"))
    assert tuple(files.read_dat(spark, str(tmp_path / "movies.dat"), "movies").first()) == (1, "Caf\xe9 (1999)", "Drama|War")


def test_enriched_defaults(spark, tmp_path):
    (tmp_path / "e.csv").write_text("movieId,overview,runtime\n1,x,90\n2,,bad\n")
    got = files.read_enriched(spark, str(tmp_path / "e.csv")).orderBy("movieId").collect()
    assert (got[0].runtime, got[1].runtime, got[0].keywords, got[0].enrichment_status) == (90.0, 0.0, "", "enriched")
    assert files.first_existing(spark, str(tmp_path), ["none.csv", "e.csv"]).endswith("e.csv")


def test_bundle_splits_export_and_artifact(spark, ratings, tmp_path):
    files.write_bundle({"ratings": ratings}, str(tmp_path / "b"))
    files.write_bundle({"ratings": ratings.limit(3)}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/ratings")).count() == 3
    s = split.temporal_split(ratings)
    files.write_splits(s, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().count() == 3
    files.write_export(s, str(tmp_path / "x"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "x/all"))
    assert back.columns == ["user_id:token", "item_id:token", "rating:float", "timestamp:float"] and back.count() == 10
    files.save_artifact(str(tmp_path / "m"), {"weights": [0.5]}, item_factors=spark.createDataFrame([(1, [0.1])], "movieId long, factors array<double>"))
    manifest, tables = files.load_artifact(spark, str(tmp_path / "m"))
    assert manifest["weights"] == [0.5] and tables["item_factors"].count() == 1
    files.write_report(ratings.limit(2), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r.md")).count() == 4
    padded = spark.createDataFrame([("[PAD]", [0.0]), ("7", [1.0])], "id string, factors array<double>")
    assert files.external_factors(padded, "id", "movieId").first().movieId == 7


def test_streams_equal_batches(spark, ratings, tmp_path):
    files.append_rating(spark, str(tmp_path / "in"), 1, 5, 2.0, 99)
    with pytest.raises(ValueError):
        files.append_rating(spark, str(tmp_path / "in"), 1, 5, 7.0, 99)
    ratings.write.mode("append").parquet(str(tmp_path / "in"))
    stream.keep_latest(stream.incoming(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {r.movieId: r.rating for r in stream.latest_table(spark, str(tmp_path / "t")).read().collect()}
    assert got[5] == 2.0 and len(got) == 10


def test_crawl_bundle_with_mappings(spark, tmp_path):
    movies = spark.createDataFrame(
        [("m1", "Heat (1995)", "1995", "https://x.org/film/heat/", 1), ("m2", "Heat", "1995", "https://x.org/film/heat/", 2), ("m3", "Ran", "", "https://x.org/film/ran/", 3)],
        "movie_id string, title string, year string, movie_url string, seq int",
    )
    ratings = spark.createDataFrame(
        [("ann", "m1", "4.5", None, 5, 1), ("ann", "m2", "3.0", None, 9, 2), ("bob", "m3", None, "true", 1, 3), ("bob", "m1", "9", None, 2, 4)],
        "user_id string, movie_id string, rating string, liked string, timestamp int, seq int",
    )
    files.write_bundle(files.crawl_bundle(movies, ratings), str(tmp_path))
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert sorted(tuple(r) for r in read("movies").select("movieId", "title", "year").collect()) == [(1, "Heat (1995)", "1995"), (2, "Ran", "")]
    assert sorted(tuple(r) for r in read("ratings").collect()) == [(1, 1, 3.0, 9), (2, 1, 5.0, 2), (2, 2, 5.0, 1)]
    assert sorted((r.raw_movie_id, r.movieId) for r in read("movie_id_mapping").collect()) == [("m1", 1), ("m2", 1), ("m3", 2)]
    assert sorted((r.raw_user_id, r.userId) for r in read("user_id_mapping").collect()) == [("ann", 1), ("bob", 2)]
    assert read("tags").count() == 0 and {r.tmdbId for r in read("links").collect()} == {""}


def test_reports_and_manifests_as_rows(spark, tmp_path):
    import json

    from tamarack.operators import evaluate, leaderboard

    (tmp_path / "report.json").write_text(json.dumps([{"model": "BPR", "test_result": {"ndcg@10": 0.2, "recall@10": 0.1}, "command": "run"}, {"model": "Pop", "test_result": {"ndcg@10": 0.1}, "artifact_dir": "a/pop"}]))
    (tmp_path / "recbole-bpr").mkdir()
    (tmp_path / "recbole-bpr" / "manifest.json").write_text("{}")
    runs, metrics = files.report_rows(spark, str(tmp_path / "report.json"), "ml", str(tmp_path))
    rows = {r.model: r for r in leaderboard.leaderboard_rows(leaderboard.normal_metrics(metrics), runs, evaluate.PROTOCOL).collect()}
    assert (rows["recbole-BPR"]["ndcg@10"], rows["recbole-BPR"]["recall@10"], rows["recbole-BPR"]["command"]) == (0.2, 0.1, "run")
    assert rows["recbole-BPR"].artifact_dir == f"{tmp_path}/recbole-bpr" and rows["recbole-Pop"].artifact_dir == "a/pop" and rows["recbole-Pop"].seed == 42
    (tmp_path / "best").mkdir()
    (tmp_path / "best" / "manifest.json").write_text(json.dumps({"dataset": "ml", "model_name": "LightGCN", "tuning": {"k": 1}, "weights": {"cf": 0.5}, "metrics": {"ndcg_at_k": 0.3, "all_ndcg_at_k": 0.25}}))
    runs, metrics = files.manifest_rows(spark, str(tmp_path / "best" / "manifest.json"))
    row = leaderboard.leaderboard_rows(leaderboard.normal_metrics(metrics), runs, evaluate.PROTOCOL).collect()[0]
    assert (row.model_family, row.source, row["ndcg@10"], row["warm_ndcg@10"], row.tuned_weights) == ("hybrid", "tuned_hybrid", 0.25, 0.3, '{"cf":0.5}')


def test_quality_report_files(spark, tmp_path):
    from tamarack.operators import quality

    movies = spark.createDataFrame([(1, "A", "x"), (2, "B", "(no genres listed)")], "movieId long, title string, genres string")
    ratings = spark.createDataFrame([(1, 1, 4.0, 0), (1, 3, 2.0, 0)], "userId long, movieId long, rating double, timestamp long")
    enriched = spark.createDataFrame([(1, "text"), (2, " ")], "movieId long, overview string")
    files.write_quality_report(quality.report(movies, ratings, enriched), str(tmp_path))
    text = [r.value for r in spark.read.text(f"{tmp_path}/data_quality.md").collect()]
    assert "- coverage overview: 50.0" in text and "- issues no_genres: 1.0" in text and "- orphans ratings_without_movie: 1.0" in text
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/content_issues.csv").collect()] == [("no_genres", "1.0")]


def test_exported_factors(spark, tmp_path):
    users = spark.createDataFrame([("[PAD]", [0.0]), ("7", [1.0])], "id string, factors array<double>")
    files.export_factors(str(tmp_path), {"model_name": "x"}, users, users)
    manifest, tables = files.load_artifact(spark, str(tmp_path))
    assert manifest["model_name"] == "x" and [tuple(r) for r in tables["user_factors"].collect()] == [(7, [1.0])]


def test_splits_in_order(spark, tmp_path):
    rows = [(u, m, 3.0, 100 - m, s) for u in range(40) for m in range(6) for s in [("train", "train", "test")[m % 3]]]
    split = spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long, split string")
    files.write_splits(split, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == len(rows)
    assert {r.split for r in spark.read.parquet(str(tmp_path)).select("split").distinct().collect()} == {"train", "test"}


def test_crawl_files_by_source(spark, tmp_path):
    for name in ("movies_seed.csv", "ratings.csv", "movies_cf.csv"):
        (tmp_path / name).write_text("x\n1\n")
    (tmp_path / "ratings_cf.csv").write_text("")
    assert files.crawl_files(spark, str(tmp_path)) == (f"{tmp_path}/movies_seed.csv", f"{tmp_path}/ratings.csv")
    with pytest.raises(FileNotFoundError):  # empty
        files.crawl_files(spark, str(tmp_path), "cf")
    with pytest.raises(ValueError):
        files.crawl_files(spark, str(tmp_path), "other")


def test_a_bundle_whose_move_fails_is_put_back(spark, tmp_path):
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    files.write_bundle({"a": table(1), "b": table(1)}, str(tmp_path))
    (tmp_path / ".staged").mkdir(exist_ok=True)

    class Broken:
        """Stands for a table whose staged folder is lost before it can be moved."""

        sparkSession = spark

        @property
        def write(self):
            return self

        def mode(self, _):
            return self

        def parquet(self, _):
            pass

    with pytest.raises(OSError):
        files.write_bundle({"a": table(2), "b": Broken()}, str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{n}").first().v for n in "ab"] == [1, 1]
