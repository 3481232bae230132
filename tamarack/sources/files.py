"""Reading and writing of catalogs, ratings, exports, reports and model artifacts as files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prepare import require_columns

RATINGS = "userId long, movieId long, rating double, timestamp long"
MOVIES = "movieId long, title string, genres string"
TAGS = "userId long, movieId long, tag string, timestamp long"
LINKS = "movieId long, imdbId string, tmdbId string"
DAT = {"movies": MOVIES, "ratings": RATINGS, "users": "userId long, gender string, age int, occupation int, zipCode string"}
#: Columns that enrichment files may lack, with the defaults of their kinds.
TEXT = ("keywords", "tag_genome_tags", "original_language", "production_companies", "production_countries", "collection_name", "release_date", "certification")
NUMBERS = ("runtime", "vote_average", "vote_count", "popularity", "collection_id")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, in whichever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getContentSummary(p).getLength() > 0


def first_existing(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    """Path of the first of the names that exists and is not empty."""
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


#: The crawl's files of movies and of ratings, by source.
CRAWL_FILES = {"full": ("movies_seed.csv", "ratings.csv"), "cf": ("movies_cf.csv", "ratings_cf.csv")}


def crawl_files(spark: SparkSession, folder: str, source: str = "full") -> tuple[str, str]:
    """Paths of the crawl's movies and ratings for a source: full, or cf (the k-core); both must be there and not empty."""
    if source not in CRAWL_FILES:
        raise ValueError(f"unknown source {source}: one of {', '.join(CRAWL_FILES)}")
    return tuple(first_existing(spark, folder, [name]) for name in CRAWL_FILES[source])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """A file with a header, matched by name: columns of `schema` are cast (null where that fails), other columns go.

    Texts may hold line breaks; a file read with that in mind is one task's. Files of numbers are read
    without it, and split.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline).csv(path)
    if schema is None:
        return raw
    fields = [x.split() for x in schema.split(", ")]
    require_columns(raw, [n for n, _ in fields if n != "timestamp"], path)
    return raw.select(*[(F.col(n).try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k in fields])


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MOVIES).withColumn("genres", F.coalesce("genres", F.lit("")))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings; without timestamps, the order of the rows stands in for them."""
    raw = read_csv(spark, path, multiline=False)
    if "timestamp" in raw.columns:
        return read_csv(spark, path, RATINGS, multiline=False)
    numbered = read_csv(spark, path, RATINGS, multiline=False).drop("timestamp").withColumn("at", F.monotonically_increasing_id())  # grows along the file
    from ..operators.prepare import dense_ids

    return numbered.join(dense_ids(numbered, "at", start=0, out="timestamp"), "at").drop("at")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_csv, or no rows if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = read_csv(spark, path, schema)
    return df.withColumn("tag", F.coalesce("tag", F.lit(""))) if "tag" in df.columns else df


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Enrichment as text, ids and numbers cast; absent columns get defaults, and the status `enriched`."""
    df = read_csv(spark, path)
    df = df.withColumn("movieId", F.col("movieId").try_cast("long"))
    df = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in NUMBERS})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in TEXT})
    return df.withColumn("enrichment_status", F.coalesce("enrichment_status", F.lit("enriched")) if "enrichment_status" in df.columns else F.lit("enriched"))


def read_tag_genome(spark: SparkSession, path: str, top_n: int = 20, min_relevance: float = 0.35) -> DataFrame:
    """movieId, tag_genome_tags of a file in either layout: one row per tag, or texts."""
    raw = read_csv(spark, path)
    if {"tag", "relevance"} <= set(raw.columns):
        from ..operators.prepare import top_genome_tags

        rows = raw.select(F.col("movieId").try_cast("long").alias("movieId"), F.col("tag").alias("tagId"), F.col("relevance").try_cast("double").alias("relevance"))
        return top_genome_tags(rows, rows.select("tagId", F.col("tagId").alias("tag")).distinct(), top_n, min_relevance)
    require_columns(raw, ["movieId", "tag_genome_tags"], path)
    return raw.select(F.col("movieId").try_cast("long").alias("movieId"), F.coalesce("tag_genome_tags", F.lit("")).alias("tag_genome_tags"))


def read_genome(spark: SparkSession, scores: str, tags: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, scores, "movieId long, tagId long, relevance double", multiline=False), read_csv(spark, tags, "tagId long, tag string")


def read_dat(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """movies, ratings or users in `::`-separated Latin-1 files."""
    columns = [x.split() for x in DAT[kind].split(", ")]
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    part = F.split("value", "::")
    return lines.select(*[F.try_element_at(part, F.lit(i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(columns)])


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Benchmark reports or manifests (JSON files) as rows, with the path that each came from."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())


def _metric_rows(reports: DataFrame, run: Column, values: Column) -> DataFrame:
    """(run, metric, value) of a struct of numbers, whatever its fields are; what is no number is left out."""
    pairs = F.from_json(F.to_json(values), "map<string, string>")
    return reports.select(run.alias("run"), F.explode(pairs).alias("metric", "value")).select("run", "metric", F.col("value").try_cast("double").alias("value")).where("value is not null")


def report_rows(spark: SparkSession, pattern: str, dataset: str, artifact_root: str = "") -> tuple[DataFrame, DataFrame]:
    """(runs, metrics) for leaderboard rows, of external benchmark reports: lists of model, test_result, and perhaps artifact_dir and command.

    A run without its own folder of artifacts has <artifact_root>/recbole-<model> if a manifest lies there.
    """
    rows = read_reports(spark, pattern)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    rows = rows.withColumn("run", F.xxhash64("path", F.to_json(F.struct(*rows.columns))))
    guess = F.concat(F.lit(artifact_root.rstrip("/") + "/recbole-"), F.lower(text("model")))
    runs = rows.select("run", F.lit(dataset).alias("dataset"), F.concat(F.lit("recbole-"), text("model")).alias("model"), F.lower(text("model")).alias("model_family"), F.lit("recbole").alias("source"), text("artifact_dir").alias("artifact_dir"), text("command").alias("command"), guess.alias("guess"))
    if artifact_root:
        there = [r[0] for r in runs.select("guess").distinct().collect() if exists(spark, f"{r[0]}/manifest.json")]  # a row for each model
        runs = runs.withColumn("artifact_dir", F.when((F.col("artifact_dir") == "") & F.col("guess").isin(there), F.col("guess")).otherwise(F.col("artifact_dir")))
    return runs.drop("guess"), _metric_rows(rows, F.col("run"), F.col("test_result"))


def manifest_rows(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(runs, metrics) for leaderboard rows, of model manifests: dataset, model_name, model_source, weights, tuning and metrics."""
    from ..functions.text import model_family

    rows = read_reports(spark, pattern)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    source = F.when(has("tuning").isNotNull(), "tuned_hybrid").otherwise(F.coalesce(has("model_source"), F.lit("artifact")))
    rows = rows.withColumns({"folder": folder, "model": F.coalesce(has("model_name"), F.regexp_extract(folder, "[^/]*$", 0)), "source": source})
    weights = F.coalesce(F.to_json(F.col("weights")), F.lit("{}")) if "weights" in rows.columns else F.lit("{}")
    runs = rows.select(F.xxhash64("path").alias("run"), F.coalesce(has("dataset"), F.lit("")).alias("dataset"), "model", model_family(F.col("model"), F.col("source")).alias("model_family"), "source", weights.alias("tuned_weights"), F.col("folder").alias("artifact_dir"))
    inner = F.col("metrics")
    if "test" in rows.select("metrics.*").columns:  # nested results count
        inner = F.col("metrics.test")
    return runs, _metric_rows(rows, F.xxhash64("path"), inner)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a plain folder: all are written aside, then moved into place one by one, old ones first aside.

    A reader never sees half a table, but for a moment it may find a table missing, or old beside new;
    a set that must change at once is versions.TableSet's. If a move fails, the old tables are put back.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/.staged/{name}")
    spark = next(iter(tables.values())).sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source: object, target: object) -> bool:
        try:
            return fs.rename(source, target)
        except Py4JJavaError:  # some file systems raise where others say no
            return False

    fs.delete(path(f"{folder}/.old"), True)
    fs.mkdirs(path(f"{folder}/.old"))
    moved = []
    for name in tables:
        target, aside = path(f"{folder}/{name}"), path(f"{folder}/.old/{name}")
        had = fs.exists(target)
        if (had and not move(target, aside)) or not move(path(f"{folder}/.staged/{name}"), target):
            for done, was in [*moved, (name, had)]:
                if was and fs.exists(path(f"{folder}/.old/{done}")):
                    fs.delete(path(f"{folder}/{done}"), True)
                    move(path(f"{folder}/.old/{done}"), path(f"{folder}/{done}"))
            raise OSError(f"could not move {name} into {folder}")
        moved.append((name, had))
    fs.delete(path(f"{folder}/.old"), True)


def crawl_bundle(movies: DataFrame, ratings: DataFrame) -> dict[str, DataFrame]:
    """Tables of a bundle from crawled movies(movie_id, title, year, movie_url, seq) and ratings(user_id, movie_id, rating, liked, timestamp, seq).

    Films of one canonical key become one movie; ids are dense from 1, in order of key and of user
    name; of several ratings of a pair the last counts. movie_id_mapping and user_id_mapping lead
    back to the crawled ids; tags are empty, links blank.
    """
    from ..functions.text import canonical_key, normal_rating, parsed_year, slug_of_url, with_year
    from ..operators.prepare import dense_ids, keep_one

    year = parsed_year(F.col("year"), F.col("title"))
    keyed = movies.withColumn("year", year).withColumn("canonical_key", canonical_key(slug_of_url(F.col("movie_url")), F.col("title"), F.col("year")))
    numbered = keyed.join(dense_ids(keyed, "canonical_key", out="movieId"), "canonical_key")
    first = keep_one(numbered, ["movieId"], [F.col("seq"), F.col("movie_id")])
    users = dense_ids(ratings, "user_id", out="userId")
    known = numbered.select("movie_id", "movieId").distinct()
    every = ratings.join(users, "user_id").join(known, "movie_id").withColumn("rating", normal_rating(F.col("rating"), F.col("liked")))
    own = first.select("movieId", with_year(F.col("title"), F.col("year")).alias("title"), F.lit("(no genres listed)").alias("genres"), "year")
    spark = movies.sparkSession
    return {
        "movies": own,
        "ratings": keep_one(every, ["userId", "movieId"], [F.desc("timestamp"), F.desc("seq")]).select("userId", "movieId", "rating", "timestamp"),
        "tags": spark.createDataFrame([], "userId long, movieId long, tag string, timestamp long"),
        "links": own.select("movieId", F.lit("").alias("imdbId"), F.lit("").alias("tmdbId")),
        "movie_id_mapping": numbered.select(F.col("movie_id").alias("raw_movie_id"), "canonical_key", "title", F.col("movie_url").alias("raw_movie_url"), "movieId"),
        "user_id_mapping": users.select(F.col("user_id").alias("raw_user_id"), "userId"),
    }


def write_splits(split: DataFrame, folder: str) -> None:
    """A folder for each split, whose files are ranges of users, each in order."""
    split.repartitionByRange("userId").sortWithinPartitions("split", "userId", "timestamp", "movieId").write.mode("overwrite").partitionBy("split").parquet(folder)


def interaction_export(split: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Positives in the typed-header form, with their split."""
    return split.where(F.col("rating") >= threshold).select(
        "split", F.col("userId").alias("user_id:token"), F.col("movieId").alias("item_id:token"), F.col("rating").alias("rating:float"), F.col("timestamp").cast("double").alias("timestamp:float")
    )


def write_export(split: DataFrame, folder: str, threshold: float = 4.0) -> None:
    """Tab-separated files with a typed header, a folder for each split and one for all."""
    rows = interaction_export(split, threshold)
    for name in ("train", "validation", "test"):
        rows.where(F.col("split") == name).drop("split").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}")
    rows.drop("split").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/all")


def write_summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def markdown_lines(rows: DataFrame, *order: Column | str) -> DataFrame:
    """(place, line): a Markdown table of all rows, in order; floats have four decimals."""
    shown = [F.format_string("%.4f", F.col(f"`{f.name}`")) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`").cast("string") for f in rows.schema.fields]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in shown]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + " --- |" * len(rows.columns))], "place int, line string")
    placed = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("place"), line.alias("line"))  # a report's rows: one file takes them all anyway
    return head.unionByName(placed)


def write_report(rows: DataFrame, prefix: str, *order: Column | str) -> None:
    """A report's rows as JSON, CSV and a Markdown table, in order (by all columns if none is given)."""
    order = order or tuple(f"`{c}`" for c in rows.columns)
    one = rows.coalesce(1).sortWithinPartitions(*order)
    one.write.mode("overwrite").json(f"{prefix}.json")
    one.write.mode("overwrite").option("header", True).csv(f"{prefix}.csv")
    markdown_lines(rows, *order).coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(f"{prefix}.md")


def write_quality_report(report: DataFrame, folder: str) -> None:
    """A quality report (section, name, value, text) as JSON, coverage and issues as CSV, and a Markdown text."""
    report.coalesce(1).sortWithinPartitions("section", "name").write.mode("overwrite").json(f"{folder}/data_quality.json")
    for name, section in (("content_coverage", "coverage"), ("content_issues", "issues")):
        report.where(F.col("section") == section).select("name", "value").coalesce(1).sortWithinPartitions("name").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    said = F.concat(F.lit("- "), F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.concat_ws(": ", F.concat_ws(" ", "section", "name"), F.col("value").cast("string"))))
    report.coalesce(1).sortWithinPartitions("section", "name").select(said).write.mode("overwrite").text(f"{folder}/data_quality.md")


def append_rating(spark: SparkSession, path: str, user: int, movie: int, rating: float, timestamp: int) -> None:
    if not 0.5 <= rating <= 5:
        raise ValueError("a rating lies between 0.5 and 5")
    spark.createDataFrame([(user, movie, rating, timestamp)], RATINGS).write.mode("append").parquet(path)


def save_artifact(folder: str, manifest: dict, **tables: DataFrame) -> None:
    """Model tables (user_factors, item_factors, content_vectors) and a manifest."""
    write_bundle(tables, folder)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest | {"files": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load_artifact(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    return manifest, {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["files"]}


def export_factors(folder: str, manifest: dict, users: DataFrame, items: DataFrame, user_id: str = "id", item_id: str = "id") -> None:
    """An external model's factors, or those of an ALS fit, as an artifact: tables user_factors and item_factors without padding rows."""
    save_artifact(folder, manifest, user_factors=external_factors(users, user_id, "userId"), item_factors=external_factors(items, item_id, "movieId"))


def external_factors(factors: DataFrame, id_col: str, out: str) -> DataFrame:
    """(id, factors) of an external model, without its padding row."""
    return factors.where(F.col(id_col).cast("string") != "[PAD]").select(F.col(id_col).try_cast("long").alias(out), "factors")
