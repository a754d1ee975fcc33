"""Source trees as DataFrames: listing with pruned folders, ignore rules, size cut, language by extension, hashes.

Folders are listed on the driver with the file system's own interface, so hidden files (whose names begin with _ or .) are seen and
ignored folders are never entered; only the paths that are left are read, by the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names never entered or read, and languages by extension.
SKIPPED = [".git", ".hg", ".svn", "vendor", "node_modules", ".cache", "__pycache__", ".DS_Store"]
LANGUAGES = {"go": "go", "py": "python", "pyi": "python", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript"}
MOST_BYTES = 512 * 1024
FILES = "rel_path string, language string, hash string, content string"


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob over a relative path: ** crosses folders, * and ? don't; {a,b}, [abc] and [!abc] are known."""
    out, k, open_ = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", r"\\") + "]", end
        elif c == "{":
            out, open_ = out + "(?:", open_ + 1
        elif c == "}" and open_:
            out, open_ = out + ")", open_ - 1
        elif c == "," and open_:
            out += "|"
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def ignore_globs(text: str) -> list[str]:
    """The globs of an ignore file: comments, empty lines and negations are left out; one without a slash matches at any depth."""
    found = []
    for line in map(str.strip, text.split("\n")):
        if not line or line[0] in "#!":
            continue
        pattern = line.removeprefix("/").removesuffix("/")
        found.append(pattern if "/" in pattern else f"**/{pattern}")
    return found


def _patterns(globs: list[str]) -> list[re.Pattern]:
    found = []
    for g in globs:
        try:
            found.append(re.compile(glob_pattern(g)))
        except re.error:  # a glob that can't be read is no glob
            continue
    return found


def is_ignored(rel_path: str, globs: list[str], folder: bool = False) -> bool:
    """Whether a file (or a folder, with or without its last slash) is skipped always, or it or its name matches a glob."""
    name = rel_path.rpartition("/")[2]
    if name in SKIPPED:
        return True
    return any(p.fullmatch(x) for p in _patterns(globs) for x in ([rel_path, name] + ([f"{rel_path}/"] if folder else [])))


def ignored(path: Column, globs: list[str]) -> Column:
    """is_ignored for files and all folders above them, as a column, for listings that are there already."""
    hard = "|".join(map(re.escape, SKIPPED))
    found = path.rlike(f"(^|/)({hard})(/|$)")
    for g in globs:
        p = glob_pattern(g)
        # the path, a folder that it is in, or the name of one of these
        found = found | path.rlike(f"^(?:{p})/?(?:/.*)?$") | path.rlike(f"(?:^|/)(?:{p.replace('.*', '[^/]*')})(?:/|$)")
    return found


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def listing(spark: SparkSession, root: str, globs: list[str] | None = None, most_bytes: int = MOST_BYTES) -> list[tuple[str, str]]:
    """Relative path and full path of each regular file of at most so many bytes that is not ignored, the root's ignore file counted."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    rules = list(globs or [])
    own = jvm.org.apache.hadoop.fs.Path(base, ".gitignore")
    if fs.exists(own):
        rules += ignore_globs(jvm.org.apache.commons.io.IOUtils.toString(fs.open(own), "UTF-8"))
    patterns = _patterns(rules)

    def skipped(rel: str, folder: bool) -> bool:
        name = rel.rpartition("/")[2]
        return name in SKIPPED or any(p.fullmatch(x) for p in patterns for x in ([rel, name, f"{rel}/"] if folder else [rel, name]))

    found, waiting = [], [("", base)]
    while waiting:
        prefix, at = waiting.pop()
        try:
            entries = fs.listStatus(at)
        except Exception:  # noqa: BLE001 - a folder that can't be read is left out
            continue
        for e in entries:
            rel = prefix + e.getPath().getName()
            if e.isDirectory():
                if not skipped(rel, True):
                    waiting.append((f"{rel}/", e.getPath()))
            elif e.isFile() and e.getLen() <= most_bytes and not skipped(rel, False):
                found.append((rel, e.getPath().toString()))
    return sorted(found)


def _read(batches):
    """The bytes of each path, by the file system that Arrow knows; files that are gone meanwhile are left out."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        rel, content = [], []
        for r, p in zip(batch.column("rel_path").to_pylist(), batch.column("path").to_pylist(), strict=True):
            try:
                system, at = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with system.open_input_stream(at) as f:
                    content.append(f.read())
                rel.append(r)
            except OSError:
                continue
        yield pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array(content, pa.binary())], names=["rel_path", "content"])


def files(spark: SparkSession, root: str, globs: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rel_path, language, hash, content of the readable files under root; what is ignored or oversize is not opened."""
    found = listing(spark, root, globs, most_bytes)
    if not found:
        return spark.createDataFrame([], FILES)
    rows = spark.createDataFrame(found, "rel_path string, path string").repartition(max(1, min(len(found) // 64, 10_000)))
    kept = rows.mapInArrow(_read, "rel_path string, content binary")
    return kept.select("rel_path", language(F.col("rel_path")).alias("language"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def paths(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(rel_path) with what listing has of each, and whether it is deleted; paths that leave the root are dropped."""
    inside = wanted.select("rel_path").distinct().where(~F.col("rel_path").rlike(r"^/|(^|/)\.\.(/|$)"))
    return inside.join(listing, "rel_path", "left").withColumn("deleted", F.col("hash").isNull())
