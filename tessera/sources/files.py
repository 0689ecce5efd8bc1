"""Files of the shared file system, by Spark's own file-system layer: paths, single result files, small texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several places that exists."""
    for path in paths:
        fs, where = _fs(spark, path)
        if fs.exists(where):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Put new in the place of path."""
    fs, old = _fs(spark, path)
    fs.delete(old, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), old):
        raise OSError(f"can't rename {new}")


def write_single(ordered: DataFrame, path: str, sep: str = "\t") -> None:
    """One file with a header, in the order of the rows. Parts are written in parallel and then joined byte by byte, so no task or driver holds the whole."""
    spark, parts = ordered.sparkSession, f"{path}.parts"
    ordered.write.mode("overwrite").options(sep=sep, header=False, emptyValue="", nullValue="", quote='"' if sep == "," else "").csv(parts)
    fs, where = _fs(spark, f"{path}.new")
    _, folder = _fs(spark, parts)
    out = fs.create(where, True)
    out.write(bytearray((sep.join(ordered.columns) + "\n").encode()))
    found = sorted((s.getPath() for s in fs.listStatus(folder)), key=lambda p: p.getName())
    for part in found:
        if part.getName().startswith("part-"):
            own = fs.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
            own.close()
    out.close()
    fs.delete(folder, True)
    swap(spark, f"{path}.new", path)
