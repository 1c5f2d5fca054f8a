"""Source trees: files read by Spark, and the predicates that decide which of them are analysed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions import catalog
from graphloom.functions.text import base_name, byte_view, directories

BYTES_IN_BATCH = 8 << 20
WANTED = r"(?i)(^|/)block\.json$|\.(php|js|jsx|ts|tsx)$"


def glob_pattern(glob: str) -> str:
    """The regular expression of one ignore line by git's rules: anchored by a slash, `*` within a segment, `**` across."""
    directory, rooted = glob.endswith("/"), "/" in glob.rstrip("/")
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?|\[[^\]/]+\])", glob.strip("/")):
        kind = f"[{'^' * part.startswith('[!')}{part[1:-1].lstrip('!')}]" if part.startswith("[") and part.endswith("]") else re.escape(part)
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, kind)
    return ("^" if rooted else "(?:^|/)") + out + ("/" if directory else "(?:$|/)")


def loose_pattern(glob: str) -> str | None:
    """The regular expression of one ignore line where a line may fit anywhere in a path: `log` fits `catalog.php`, and
    `/foo` fits `bar/foo`. None where it never fits: a line with a bracket, or a folder's line of several parts."""
    body = glob.rstrip("/")
    inner = body.lstrip("/")
    if "[" in inner or glob.endswith("/") and not body.startswith("/") and "/" in inner:
        return None
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in inner.encode().decode("latin-1"))


def ignore_pattern(globs: Sequence[str], strict: bool = False) -> str | None:
    """All ignore lines as one regular expression, for byte_view() of relative paths; blank lines, comments and negations
    go. `strict` follows git's rules, else a line fits anywhere. None if nothing can fit."""
    lines = [g.strip() for g in globs if g.strip() and g.strip()[0] not in "#!"]
    found = [glob_pattern(g.encode().decode("latin-1")) if strict else loose_pattern(g) for g in lines]
    kept = sorted({f for f in found if f is not None})
    return "|".join(f"(?:{f})" for f in kept) if kept else None


def ignored(path: Column, globs: Sequence[str] = (), strict: bool = False) -> Column:
    """Whether a relative path is in a skipped or hidden directory, or fits an ignore line."""
    parts = F.split(path, "/")
    hidden = F.exists(directories(path), lambda s: s.startswith(".")) | F.exists(parts, lambda s: s.isin(*catalog.SKIPPED_DIRECTORIES))
    lines = ignore_pattern(globs, strict)
    return hidden if lines is None else hidden | byte_view(path).rlike(lines)


def is_minified(path: Column, content: Column) -> Column:
    """By the name, or by a source map named in the last 200 bytes."""
    suffix = "|".join(re.escape(s) for s in catalog.MINIFIED_SUFFIXES)
    return F.lower(base_name(path)).rlike(f"({suffix})$") | F.right(byte_view(content), F.lit(200)).contains("sourceMappingURL=")


def has_marker(content: Column, markers: Sequence[str] = (*catalog.GENERATED_MARKERS, *catalog.BUNDLER_MARKERS), within: int = 512) -> Column:
    """Whether a mark of generators or bundlers stands in the first bytes, in any case."""
    head = F.lower(F.left(byte_view(content), F.lit(within)))
    found = F.lit(False)
    for m in markers:
        found = found | head.contains(m.lower())
    return found


def has_long_lines(content: Column, mean: int = 110, lines: int = 100, within: int = 8192) -> Column:
    """Whether the first lines have more than `mean` bytes each on average; one over 511 bytes counts as several."""
    some = F.slice(F.split(F.regexp_replace(F.left(byte_view(content), F.lit(within)), r"([^\n]{511})(?=[^\n])", "$1\n"), "\n"), 1, lines)
    return F.aggregate(some, F.lit(0), lambda s, x: s + F.length(x)) > F.size(some) * mean


def header(content: Column, name: str) -> Column:
    """Value of a header line in the first 8 KB, null without one."""
    return F.nullif(F.trim(F.regexp_extract(F.left(content, F.lit(8192)), rf"(?i){re.escape(name)}\s*:\s*(.+)", 1)), F.lit(""))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content of wanted files under `root`, in any store that Spark reads; a folder that isn't there
    gives no rows. Names with a leading `_` or `.` count, which Spark's own listing leaves out.

    A folder that every machine has mounted is listed and read in tasks by the data source `source_tree`. Of other
    stores the paths are listed through Hadoop's client, and content is read in tasks, but that of hidden names, which
    are few, through the driver."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", root)
    if local:
        listed = spark.read.format("source_tree").option("root", local[1]).load() if _registered(spark) else None
        return read_paths(listed.repartition(spark.sparkContext.defaultParallelism, "path"), local[1])
    fs, start = _store(spark, root)
    if not fs.exists(start):
        return spark.createDataFrame([], "path string, content string")
    base = fs.getFileStatus(start).getPath().toString().rstrip("/") + "/"
    found, listing = [], fs.listFiles(start, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        if re.search(WANTED, name):
            found.append(name)
    plain = [p for p in found if not any(x[0] in "_." for x in p.removeprefix(base).split("/"))]
    hidden = [p for p in found if p not in set(plain)]
    rows = spark.createDataFrame([], "path string, content binary")
    if plain:
        rows = rows.union(spark.read.format("binaryFile").load(plain).select("path", "content"))
    if hidden:
        rows = rows.union(spark.createDataFrame([(p, _bytes(spark, p)) for p in hidden], "path string, content binary"))
    short = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    lead = re.sub("^[a-z]+:/*", "/", base)
    return rows.select(F.replace(short("path"), F.lit(lead), F.lit("")).alias("path"), F.col("content").cast("string").alias("content"))


def _registered(spark: SparkSession) -> bool:
    spark.dataSource.register(SourceTree)
    return True


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """path, content of `paths` (path) below `root`, read in tasks, a bounded number of bytes at a time."""
    base = root.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held = [], [], 0
        for b in batches:
            for name in b.column("path").to_pylist():
                with open(f"{base}/{name}", "rb") as f:
                    data = f.read()
                names.append(name)
                texts.append(data.decode("utf-8", "replace"))
                held += len(data)
                if held > BYTES_IN_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["path", "content"])
                    names, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["path", "content"])

    return paths.select("path").mapInArrow(read, "path string, content string")


class Folders(InputPartition):
    """Folders that one task lists: those to be walked, and those of which only the files count."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class SourceTree(DataSource):
    """`source_tree`: relative paths of wanted files below the option `root`. The driver looks only at as many folders as
    make tasks enough; each task walks its own. Links are followed, a file counts under its real path, and a folder that
    has been walked on the way down to itself isn't entered again."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"], int(self.options.get("tasks", 32)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = os.path.realpath(root), tasks

    def partitions(self) -> list[Folders]:
        deep, flat = [self.root] if os.path.isdir(self.root) else [], []
        while deep and len(deep) < self.tasks:
            below = [d for f in deep for d in self.folders(f)]
            flat += deep
            deep = below
        parts = max(1, min(self.tasks, len(deep) + len(flat)))
        return [Folders(deep[i::parts], flat[i::parts]) for i in range(parts)]

    @staticmethod
    def folders(folder: str) -> list[str]:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir() and os.path.realpath(e.path) not in _above(e.path))

    def read(self, partition: Folders) -> Iterator[tuple[str]]:
        waiting = [(f, True) for f in partition.deep] + [(f, False) for f in partition.flat]
        while waiting:
            folder, deep = waiting.pop()
            with os.scandir(folder) as found:
                names = sorted(e.path for e in found if e.is_file() and re.search(WANTED, e.path))
            for path in names:
                yield (os.path.relpath(os.path.realpath(path), self.root),)
            if deep:
                waiting += [(d, True) for d in self.folders(folder)]


def _above(path: str) -> set[str]:
    """The real paths of the folders around `path`."""
    out, at = set(), os.path.dirname(path)
    while at not in ("", "/"):
        out.add(os.path.realpath(at))
        at = os.path.dirname(at)
    return out


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _bytes(spark: SparkSession, path: str) -> bytearray:
    fs, where = _store(spark, path)
    opened = fs.open(where)
    try:
        return bytearray(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(opened))
    finally:
        opened.close()


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the ignore files in the root; blank lines, comments and negations go."""
    lines = []
    for name in (".gitignore", ".profilerignore"):
        fs, where = _store(spark, f"{root.rstrip('/')}/{name}")
        if fs.exists(where):
            text = _bytes(spark, where.toString()).decode("utf-8", "replace")
            lines += [x.strip() for x in text.splitlines() if x.strip() and x.strip()[0] not in "#!"]
    return lines


def theme_header(spark: SparkSession, root: str) -> dict[str, str]:
    """name, version, description of a theme, as far as its style.css tells them."""
    fs, where = _store(spark, f"{root.rstrip('/')}/style.css")
    if not fs.exists(where):
        return {}
    text = _bytes(spark, where.toString())[:8192].decode("utf-8", "replace")
    found = {k: re.search(rf"(?i){h}\s*:\s*(.+)", text) for k, h in (("name", "Theme Name"), ("version", "Version"), ("description", "Description"))}
    return {k: m[1].strip() for k, m in found.items() if m}


def analysed(files: DataFrame, globs: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Files (path, content) that are neither ignored nor minified nor generated, with kind."""
    script = F.lower(base_name(F.col("path"))).rlike(r"\.(js|jsx|ts|tsx)$")
    made = script & (is_minified(F.col("path"), F.col("content")) | has_marker(F.col("content")) | has_long_lines(F.col("content")))
    kind = F.when(base_name(F.col("path")) == "block.json", "block").when(script, "js").otherwise("php")
    return files.where(~ignored(F.col("path"), globs, strict)).where(~made).withColumn("kind", kind)


def main_file(files: DataFrame, directory: str) -> DataFrame:
    """One row (path, name, version, description): the root file named like its directory, else the first root
    file with a header, else the first nested one."""
    c = F.col("content")
    told = files.where("kind = 'php'").withColumns({"name": header(c, "Plugin Name"), "version": header(c, "Version"), "description": header(c, "Description")}).where("name IS NOT NULL")
    nested = F.col("path").contains("/")
    order = F.when(F.col("path") == f"{directory}.php", 0).when(~nested, 1).otherwise(2)
    return told.select("path", "name", "version", "description", order.alias("order")).orderBy("order", "path").limit(1).drop("order")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """source, target: relative imports (path, name) resolved to files: as written, with an extension, or as a
    folder's index; the first that exists counts."""
    tails = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
    folder = F.array_join(directories(F.col("path")), "/")
    joined = F.filter(F.split(F.concat_ws("/", folder, F.col("name")), "/"), lambda x: (x != "") & (x != "."))
    plain = F.aggregate(joined, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))), lambda s: F.array_join(s, "/"))
    tried = imports.where(F.col("name").startswith(".")).select("path", "name", plain.alias("base")).select("path", "name", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tails])).alias("rank", "target"))
    hit = tried.join(files.select(F.col("path").alias("target")), "target")
    w = Window.partitionBy("path", "name").orderBy("rank")
    return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(F.col("path").alias("source"), "name", "target")
