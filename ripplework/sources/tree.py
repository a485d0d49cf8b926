"""Files of a tree or of a revision as relations."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplework import model
from ripplework.functions import paths as P
from ripplework.sources import git

CONTENT = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def read_tree(spark: SparkSession, root: str, repo: str, limit: int = model.MAX_FILE_BYTES,
              ignore: Sequence[str] = P.DEFAULT_IGNORE) -> DataFrame:
    """(repo, path, content, size) of a folder any executor can read.

    The size condition stays on the source's own ``length`` column, so the contents of larger
    files are never opened; they are listed with NULL content.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    # The source reports full URIs; what follows the root is the repository path.
    inside = F.element_at(F.split("path", f"(?:^|:|//){_quoted(base)}/", 2), -1)

    def shaped(frame: DataFrame, content) -> DataFrame:
        return frame.select(F.lit(repo).alias("repo"), inside.alias("path"), content.alias("content"), F.col("length").alias("size"))

    small = shaped(listed.where(F.col("length") <= limit), F.col("content"))
    large = shaped(listed.where(F.col("length") > limit).drop("content"), F.lit(None).cast("binary"))
    return small.unionByName(large).where(~P.is_ignored("path", ignore))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def supported(files: DataFrame) -> DataFrame:
    """Files some analyzer claims."""
    return files.where(P.language_of("path").isNotNull() | P.c_family_of("path").isNotNull())


def python_files(files: DataFrame) -> DataFrame:
    return files.where(P.language_of("path") == "python")


def at_revision(spark: SparkSession, root: str, revision: str, paths: DataFrame) -> DataFrame:
    """(repo, path, content) of *paths* (repo, path) at a commit; paths it lacks have no row.

    Runs git per path inside the tasks, so *root* must be readable there.
    """
    def read(batches):
        for batch in batches:
            batch["content"] = [git.committed_content(root, revision, path) for path in batch["path"]]
            yield batch[batch["content"].notna()]

    return paths.select("repo", "path").mapInPandas(read, CONTENT)


def raw_output(spark: SparkSession, repo: str, output: str) -> DataFrame:
    """One git answer as a one-row relation for the parsers."""
    return spark.createDataFrame([(repo, output)], "repo string, output string")


def listing(spark: SparkSession, repo: str, root: str | Path) -> DataFrame:
    return spark.createDataFrame([(repo, path) for path in git.listed_paths(root)], "repo string, path string")
