"""Set-based analyzers over extracted symbols: interface satisfaction, relative imports, class hierarchy, package imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a relative import may stand for, in the order in which it is tried.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def implementations(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """package, type, interface, source_class: structural if the type has all methods of the interface, speculative if some.

    methods(package, owner, method) and interfaces(package, interface, method). Pairs are found through shared methods.
    """
    m, i = methods.distinct(), interfaces.distinct()
    size = i.groupBy("package", "interface").agg(F.count("*").alias("wanted"))
    met = m.join(i, ["package", "method"]).groupBy("package", "owner", "interface").agg(F.count("*").alias("met"))
    return met.join(size, ["package", "interface"]).select("package", F.col("owner").alias("type"), "interface", F.when(F.col("met") == F.col("wanted"), "structural").otherwise("speculative").alias("source_class"))


def resolved_path(from_path: Column, spec: Column) -> Column:
    """The path that a relative one stands for, seen from a file; a .. above the root is dropped; null where nothing is left."""
    folder = F.regexp_replace(from_path, r"/?[^/]*$", "")
    parts = F.split(F.concat(F.when(folder == "", ".").otherwise(folder), F.lit("/"), spec), "/")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.nullif(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), F.lit(""))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """from_path, spec, to_path: the first candidate that is a file, for imports(from_path, spec) of files by a spec like ./a."""
    known = files.select("rel_path").distinct()
    own = imports.where(F.startswith("spec", F.lit("."))).join(known.withColumnRenamed("rel_path", "from_path"), "from_path", "left_semi")
    tried = own.select("from_path", "spec", resolved_path(F.col("from_path"), F.col("spec")).alias("raw")).where("raw is not null")
    tried = tried.select("from_path", "spec", F.posexplode(F.transform(F.lit(SUFFIXES), lambda s: F.concat("raw", s))).alias("k", "rel_path"))
    return tried.join(known, "rel_path").groupBy("from_path", "spec").agg(F.min_by("rel_path", "k").alias("to_path"))


def class_hierarchy(classes: DataFrame) -> DataFrame:
    """id, base, base_id for classes(id, label, bases array<string>, ord): the last class registered under the base's last segment."""
    known = classes.groupBy("label").agg(F.max_by("id", "ord").alias("base_id"))
    wanted = classes.select("id", F.explode("bases").alias("base")).where("base <> '' and base <> 'object'").withColumn("label", F.element_at(F.split("base", r"\."), -1))
    return wanted.join(known, "label").select("id", "base", "base_id").where("id <> base_id")


def package_imports(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """from_package, to: packages paired with the imports of their own files; only paths whose first segment has a dot."""
    own = packages.select("rel_path", F.col("label").alias("from_package")).distinct()
    return imports.where(F.split("label", "/")[0].contains(".")).join(own, "rel_path").select("from_package", F.col("label").alias("to")).distinct()


def react_components(symbols: DataFrame) -> DataFrame:
    """id, concept of exported functions and classes with a name in Pascal case in JSX files; symbols(id, label, kind, exported, source_file)."""
    pascal = F.col("label").rlike("^[A-Z][A-Za-z0-9]*$") & F.col("source_file").rlike(r"\.(tsx|jsx)$")
    return symbols.where(F.col("kind").isin("function", "class") & F.col("exported") & pascal).select("id", F.lit("component").alias("concept"))


def dunders(symbols: DataFrame) -> DataFrame:
    """source_file, names: the methods of a file that begin and end with two underscores."""
    name = F.element_at(F.split("label", r"\."), -1)
    return symbols.where((F.col("kind") == "method") & F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))).groupBy("source_file").agg(F.collect_set(name).alias("names"))


def class_concepts(classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, concept: abstract, dataclass and exception by bases and decorators, context-manager by the methods of the file.

    classes(id, source_file, bases, decorators); symbols(label, kind, source_file).
    """
    any_base = lambda names, tails: F.exists("bases", lambda b: b.isin(names) | F.lit(False) | F.exists(F.lit(tails), lambda t: F.endswith(b, t)))
    marks = F.array_compact(F.array(
        F.when(any_base(["ABC", "ABCMeta"], [".ABC", ".ABCMeta"]), "abstract"),
        F.when(F.exists("decorators", lambda d: d.contains("dataclass")), "dataclass"),
        F.when(any_base(["Exception", "BaseException"], ["Error", "Exception"]), "exception"),
    ))
    by_class = classes.select("id", F.explode(marks).alias("concept"))
    managed = dunders(symbols).where("array_contains(names, '__enter__') and array_contains(names, '__exit__')").select("source_file")
    by_file = classes.join(managed, "source_file", "left_semi").select("id", F.lit("context-manager").alias("concept"))
    return by_class.unionByName(by_file).distinct()
