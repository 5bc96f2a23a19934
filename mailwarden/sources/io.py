"""Readers and writers of datasets, the log and lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.address import clean_address

ALIASES = {"email": ("email", "email_address"), "type": ("type", "label", "classification"), "category": ("category", "subcategory")}


def normalize_label(label: Column) -> Column:
    """IO3: 1 for fraud, 1, true and numbers from 0.5; 0 for all else, null too."""
    x = F.lower(F.trim(label.cast("string")))
    number = x.try_cast("double")
    return F.coalesce(F.when(x.isin("fraud", "true"), 1).when(x.isin("legit", "false"), 0).when(number.isNotNull() & ~F.isnan(number), (number >= 0.5).cast("int")), F.lit(0))


def shared_folder(spark: SparkSession, tag: str = "work") -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; without that setting there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "work") -> DataFrame:
    """df as a table in a shared folder, so that what reads it more than once computes it once."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A field of a line of CSV that has a comma put before it: quoted, with doubled quotes inside, or plain.
FIELD = r',("(?:[^"]|"")*"|[^,"]*)'


def csv_fields(line: Column) -> Column:
    """The fields of a line of CSV; null where quotes don't pair up."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    read = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x) + 1)
    plain = F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(read == F.length(line) + 1, plain)


def _known(fields: Column, aliases: tuple[str, ...]) -> Column:
    """The first place (from 0) of a field with one of the names; null without."""
    return F.array_min(F.filter(F.transform(fields, lambda x, i: F.when(F.lower(F.trim(x)).isin(*aliases), i)), lambda i: i.isNotNull()))


def read_labeled(spark: SparkSession, path: str | list[str], keep_corrupt: bool = False) -> DataFrame:
    """IO1: email, type, category of CSV files, each with its columns in an order of its own, by known names.

    A file's header is its first line with a known name of the address column and no @; the places it gives hold for that file alone. In a file
    without one the first three columns are address, type and category. Rows without @ go; an empty field or a column that isn't there is null. With keep_corrupt
    lines whose quotes don't pair up, or with more fields than their header, come in a fourth column `corrupt`, with nulls before it; without, they go.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where(F.trim("value") != "").withColumn("fields", csv_fields(F.col("value")))
    places = {k: _known(F.col("fields"), names) for k, names in ALIASES.items()}
    titles = lines.where(~F.col("value").contains("@")).withColumns({f"at_{k}": v for k, v in places.items()}).where("at_email IS NOT NULL")
    heads = titles.groupBy("file").agg(F.min_by(F.struct(F.size("fields").alias("width"), *[f"at_{k}" for k in ALIASES]), F.struct("block", "n")).alias("head"))
    rows = lines.select("file", "value", "fields").join(heads, "file", "left")
    field = lambda k, i: F.nullif(F.trim(F.get("fields", F.when(F.col("head").isNull(), F.lit(i)).otherwise(F.col(f"head.at_{k}")))), F.lit("")).alias(k)
    bad = F.col("fields").isNull() | F.coalesce(F.size("fields") > F.col("head.width"), F.lit(False))
    read = rows.select(*[field(k, i) for i, k in enumerate(ALIASES)], F.when(bad, F.col("value")).alias("corrupt"))
    good = read.where(F.col("corrupt").isNull() & F.col("email").contains("@"))
    if not keep_corrupt:
        return good.drop("corrupt")
    return good.unionByName(read.where("corrupt IS NOT NULL").select(*[F.lit(None).cast("string").alias(k) for k in ALIASES], "corrupt"))


def read_labeled_json(spark: SparkSession, path: str) -> DataFrame:
    """IO2: email, type, category of JSON files {emails: [{email, type, category}]}."""
    schema = "generated string, count long, emails array<struct<email:string,type:string,category:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("emails").alias("e")).select("e.*")


def _saved(df: DataFrame, path: str, fmt: str, *parts: str) -> DataFrame:
    """Write df, and return what was written as a frame over the files."""
    options = {"header": True} if fmt == "csv" else {}
    df.write.mode("overwrite").options(**options).format(fmt).partitionBy(*parts).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(fmt).load(path)


def write_features(df: DataFrame, path: str, features: list[str], label: str = "label", include_email: bool = False, fmt: str = "parquet") -> dict[str, int]:
    """IO4: write the feature columns by name, the label last, the address before it if asked.

    Returned are the rows written, of these with a label of 1, and with a null among the features, counted over the written files.
    """
    saved = _saved(df.select(*sorted(features), *(["email"] if include_email else []), label), path, fmt)
    gaps = F.greatest(*[F.col(f).isNull().cast("int") for f in features], F.lit(0))
    return saved.agg(F.count("*").alias("rows"), F.count(F.when(F.col(label).cast("int") == 1, 1)).alias("positive"), F.coalesce(F.sum(gaps), F.lit(0)).alias("with_nulls")).first().asDict()


def write_clean(df: DataFrame, path: str, email: str = "email", label: str = "label", order: str = "id", source: str = "clean", fmt: str = "parquet") -> dict[str, int]:
    """Write clean_dataset's rows to path/status=kept; returned are how many were kept, duplicates and invalid.

    One pass over df writes duplicates and invalid rows too, into folders of their own, so nothing is lost; the counts come from the
    written files, for Parquet from their footers alone, so tasks that are run again don't count twice. Rows without a valid address are spread by a hash of their order.
    """
    original = F.col(email)
    cleaned = df.withColumns({"_clean": clean_address(original)})
    ranked = cleaned.withColumn("_n", F.row_number().over(W.partitionBy("_clean", F.when(F.col("_clean").isNull(), F.xxhash64(order))).orderBy(order)))
    status = F.when(F.col("_clean").isNull(), "invalid").when(F.col("_n") == 1, "kept").otherwise("duplicates")
    rows = ranked.withColumn("status", status).withColumns({email: F.coalesce("_clean", original), label: F.when(F.lower(F.col(label).cast("string")).startswith("fraud"), "fraud").otherwise("legit"), "source": F.lit(source)}).drop("_clean", "_n")
    counts = {r.status: r["count"] for r in _saved(rows, path, fmt, "status").groupBy("status").count().collect()}
    return {k: counts.get(k, 0) for k in ("kept", "duplicates", "invalid")}


def to_log_rows(df: DataFrame) -> DataFrame:
    """Rows as the log stores them: empty text is null, arrays, maps and structs are JSON, booleans are 0 or 1."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        col = F.col(f"`{f.name}`")
        out.append({"string": lambda c: F.nullif(c, F.lit("")), "array": F.to_json, "map": F.to_json, "struct": F.to_json, "boolean": lambda c: c.cast("int")}.get(kind, lambda c: c)(col).alias(f.name))
    return df.select(*out)


def append_validations(df: DataFrame, path: str) -> None:
    """IO5: append rows to the log, in folders by date, so that time filters read the days they need."""
    to_log_rows(df).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)


def read_validations(spark: SparkSession, path: str, since=None) -> DataFrame:
    log = spark.read.parquet(path)
    return log if since is None else log.where((F.col("date") >= F.lit(since.date())) & (F.col("timestamp") >= F.lit(since)))


def build_training_dataset(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """IO6: a row for each sample with a vector, newest first: features as columns, label, weight (5 for manual labels).

    The features are the sorted keys of the newest row's vector; a row that lacks one has 0. Without rows there is
    nothing to learn the columns from: label and weight alone.
    """
    rows = samples.where("feature_vector IS NOT NULL AND feature_vector != '{}'").withColumn("v", F.from_json("feature_vector", "map<string,double>"))
    newest = rows.orderBy(F.desc("timestamp"), "email_hash").select(F.map_keys("v").alias("k")).limit(1).collect()
    names = sorted(newest[0].k or []) if newest else []
    if limit is not None:
        rows = rows.orderBy(F.desc("timestamp"), "email_hash").limit(limit)
    return rows.select(*[F.coalesce(F.col("v")[n], F.lit(0.0)).alias(n) for n in names], F.col("label").cast("int").alias("label"), F.when(F.col("label_source") == "manual", 5.0).otherwise(1.0).alias("weight"))


def read_domain_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """IO7: the distinct domains of files with one a line, in lower case; blank lines and # comments go."""
    lines = spark.read.text(paths).select(F.lower(F.trim("value")).alias("domain"))
    return lines.where((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """IO8: a result as CSV with a header, or JSON."""
    if fmt not in ("csv", "json"):
        raise ValueError("fmt must be csv or json")
    df.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)
