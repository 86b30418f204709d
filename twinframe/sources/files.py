"""Source files as rows: scanning, selection, classification, manifests, incremental hashing and ignored paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import basename, glob_any

#: Fixed value: a NUL byte among the first so many bytes marks a binary file.
BINARY_HEAD = 8192


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in vocab.LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("unknown"))


def overlaps(parts: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def test_name(path: Column) -> Column:
    """Test files by the naming conventions of their languages."""
    name = F.lower(basename(path))
    stem = F.regexp_replace(name, r"\..*$", "")
    return F.startswith(stem, F.lit("test_")) | stem.rlike(r"_tests?$") | name.rlike(r"\.(test|spec)\.") | name.isin("conftest.py", "tests.py")


def flags(path: Column) -> dict[str, Column]:
    parts = F.split(F.lower(path), "/")
    fixture = overlaps(parts, vocab.FIXTURE_PARTS)
    return {
        "is_fixture": fixture,
        "is_test": fixture | overlaps(parts, vocab.TEST_PARTS) | test_name(path),
        "is_generated": overlaps(parts, vocab.GENERATED_PARTS) | F.lower(basename(path)).contains("generated"),
        "is_vendor": overlaps(parts, vocab.VENDOR_PARTS),
        "is_build_output": overlaps(parts, vocab.BUILD_PARTS),
    }


def role(path: Column) -> Column:
    """The first that applies: vendor, build output, generated, fixture, test, documentation, configuration, source."""
    f = flags(path)
    return (
        F.when(f["is_vendor"], "vendor").when(f["is_build_output"], "build_output").when(f["is_generated"], "generated").when(f["is_fixture"], "fixture").when(f["is_test"], "test")
        .when(suffix(path).isin(*vocab.DOCUMENT_SUFFIXES), "documentation").when(F.lower(basename(path)).isin(*vocab.CONFIG_NAMES) | suffix(path).isin(*vocab.CONFIG_SUFFIXES), "configuration").otherwise("source")
    )


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, content, size, modified) of every file below a folder that Spark can read."""
    base = root.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    mark = base.split("://")[-1].split(":")[-1].lstrip("/") + "/"
    return d.select(F.substring_index(F.col("path"), mark, -1).alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def describe(raw: DataFrame, include: Sequence[str] = ("**",), exclude: Sequence[str] = (), ignored: Sequence[str] = (), split_ignored: bool = True) -> DataFrame:
    """File records: language, role, flags, size, lines, hash, selected. Binary files are dropped; files of languages that aren't analysed have an empty hash and no lines.

    ignored: paths (and folders, ending in "/") that version control ignores, as its own listing gives them.
    """
    path = F.col("path")
    chosen = glob_any(path, include) & ~glob_any(path, exclude) if exclude else glob_any(path, include)
    for p in ignored:
        chosen = chosen & ~(F.startswith(path, F.lit(p)) if p.endswith("/") else path == p)
    analysed = language(path).isin(*vocab.ANALYSED)
    head = F.decode(F.substring("content", 1, BINARY_HEAD), "ISO-8859-1")
    text = F.decode("content", "ISO-8859-1")
    lines = F.length(F.regexp_replace(text, r"[^\n]", "")) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return raw.filter(F.locate("\x00", head) == 0).withColumns(
        {"language": language(path), "role": role(path), **flags(path), "selected": chosen & analysed, "content_hash": F.when(analysed, F.sha2("content", 256)).otherwise(""), "line_count": F.when(analysed, lines).otherwise(0).cast("int")}
    )


def with_known_hashes(raw: DataFrame, before: DataFrame) -> DataFrame:
    """Files with the hash of an earlier scan (path, size, modified, content_hash) where size and time agree, else computed anew."""
    known = before.select("path", "size", "modified", F.col("content_hash").alias("_known"))
    return raw.join(known, ["path", "size", "modified"], "left").withColumn("content_hash", F.coalesce("_known", F.sha2("content", 256))).withColumn("reused", F.col("_known").isNotNull()).drop("_known")


def manifests(files: DataFrame) -> DataFrame:
    """(path, kind) of project manifests; the first kind that matches."""
    kind = F.lit(None).cast("string")
    for name, patterns in reversed(vocab.MANIFESTS.items()):
        kind = F.when(glob_any(basename(F.col("path")), patterns), name).otherwise(kind)
    return files.select("path", kind.alias("kind")).filter("kind is not null")


def explain_selection(files: DataFrame, groups: int = 8) -> DataFrame:
    """How many files were left out, by first folder and language: the largest groups of a report."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return files.filter(~F.col("selected")).groupBy(top.alias("folder"), "language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder", "language").limit(groups)
