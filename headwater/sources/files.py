"""Source files as rows: scanning, classification, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes by kind, and the folders that hold factory artefacts.
SUFFIXES = {"sql": ("sql", "ddl", "dml", "hql"), "python": ("py", "pyspark"), "json": ("json",)}
FACTORY_FOLDERS = ("pipeline", "dataset", "dataflow", "trigger")
#: A further folder whose mixed case keeps it from matching lower-case path parts; fold_all lets it match.
MIXED_FOLDER = "linkedservice"
#: Constructs that the SQL parser alone doesn't cover.
FALLBACK_PATTERNS = (
    r"\bCREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\b",
    r"\bCREATE\s+(OR\s+REPLACE\s+)?FUNCTION\b",
    r"\bLANGUAGE\s+plpgsql\b",
    r"\bEXECUTE\s+IMMEDIATE\b",
    r"\bEXEC\s*\(",
    r"\bsp_executesql\b",
    r"\bBEGIN\b[\s\r\n]+(DECLARE|SET\s+@|EXEC|EXECUTE|IF\s|WHILE\s)",
    r"\bDECLARE\b[\s\S]{0,500}?\bBEGIN\b",
)
FALLBACK_LENGTH = 100
FILES = T.StructType([T.StructField("repo_idx", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("source_repo", "rel_path")], T.StructField("path", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("content", T.StringType()), T.StructField("sha256", T.StringType())])


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)


def in_factory(path: Column, fold_all: bool = False) -> Column:
    names = [*FACTORY_FOLDERS, *[MIXED_FOLDER] * fold_all]
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, names)))


def folder(path: Column) -> Column:
    """The right-most artefact folder of the path."""
    known = F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(*FACTORY_FOLDERS))
    return F.try_element_at(known, F.lit(-1))


def kind(path: Column, fold_all: bool = False) -> Column:
    """sql, python or factory; null: the file is of no concern."""
    s = suffix(path)
    return F.when(s.isin(*SUFFIXES["sql"]), "sql").when(s.isin(*SUFFIXES["python"]), "python").when(s.isin(*SUFFIXES["json"]) & in_factory(path, fold_all), "factory")


def classified(files: DataFrame) -> DataFrame:
    """files (repo_idx, source_repo, rel_path, content) with path parts, kind, folder and hash; files of no concern go."""
    out = files.withColumns({"path": F.split("rel_path", "/"), "kind": kind(F.col("rel_path")), "folder": folder(F.col("rel_path")), "sha256": F.sha2(F.col("content").cast("binary"), 256)})
    return out.filter("kind is not null").select(*FILES.names)


def known_names() -> str:
    """A glob of the known suffixes in either case: other files are not even opened."""
    return "*.{" + ",".join("".join(f"[{ch}{ch.upper()}]" for ch in x) for kinds in SUFFIXES.values() for x in kinds) + "}"


def scan(spark: SparkSession, root: str, source_repo: str = "", repo_idx: int = 0, recursive: bool = True) -> DataFrame:
    """The known files under a folder. Bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", known_names()).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    local = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:(//[^/]*)?", "")
    rel = F.substring(local, F.lit(len(whole) + 2), F.lit(1 << 20))
    rows = raw.select(F.lit(repo_idx).alias("repo_idx"), F.lit(source_repo).alias("source_repo"), rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return classified(rows if recursive else rows.filter(~F.col("rel_path").contains("/")))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (source_repo, rel_path, sha256) no earlier analysis holds."""
    return files.join(cache.select("source_repo", "rel_path", "sha256").distinct(), ["source_repo", "rel_path", "sha256"], "left_anti")


def needs_fallback(content: Column, has_derivations: Column) -> Column:
    """True for procedural constructs, or for a longer text of which nothing was derived."""
    procedural = F.lit(False)
    for p in FALLBACK_PATTERNS:
        procedural = procedural | content.rlike("(?i)" + p)
    return procedural | (~has_derivations & (F.length(F.trim(content)) > FALLBACK_LENGTH))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """(rel_path) of files that one side lacks or whose content differs."""
    both = base.select("rel_path", F.col("sha256").alias("old")).join(head.select("rel_path", F.col("sha256").alias("new")), "rel_path", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("rel_path").distinct()


def relevant(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Paths under one of the roots, of a known suffix; leading ./ of roots and backslashes don't matter."""
    p = F.regexp_replace("rel_path", r"\\", "/")
    under = F.lit(not roots)
    for r in roots:
        clean = r.replace("\\", "/").removeprefix("./").strip("/")
        under = under | F.lit(clean in ("", ".")) | (p == clean) | p.startswith(clean + "/")
    return paths.filter(under & kind(p).isNotNull())
