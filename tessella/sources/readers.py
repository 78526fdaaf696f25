"""Documents (doc_id, source, text, metadata) from files, inline texts and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import loader_normalise, strip

SUFFIXES = (".txt", ".md", ".json")
SCHEMA = "doc_id string, source string, text string, metadata map<string,string>"


#: Columns of files as Spark lists and reads them.
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Names that two files of a folder share are joined by broadcast if they are no more than so many.
FEW_NAMES = 10_000


def _finished(docs: DataFrame) -> DataFrame:
    """Normalised texts, without blank ones."""
    return docs.withColumn("text", loader_normalise(F.col("text"))).where(F.length(strip(F.col("text"))) > 0).select("doc_id", "source", "text", "metadata")


def _decoded(content: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD. The file's bytes never reach Python."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def _root(spark: SparkSession, path: str) -> str:
    """The folder below which names are told apart, as Spark writes it in front of its files; the folder of a single file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise FileNotFoundError(path)
    status = files.getFileStatus(at)
    if not status.isFile():
        return status.getPath().toString().rstrip("/")
    if not at.getName().lower().endswith(SUFFIXES):
        raise ValueError(f"a document file ends in one of {SUFFIXES}: {path}")
    return status.getPath().getParent().toString().rstrip("/")


def _named(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with source, suffix, name (the path below the root) and stem (name without its suffix), of those that hold documents."""
    place = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z]+:/+", "/"), r"%20", " ")
    below = F.regexp_replace(F.regexp_replace(F.lit(root), r"^[a-zA-Z]+:/+", "/"), r"%20", " ")
    name = F.substr(place, F.length(below) + 2)
    rows = files.withColumns({"name": name, "source": F.element_at(F.split(name, "/"), -1), "suffix": F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)), "stem": F.regexp_replace(name, r"\.[^./]*$", "")})
    return rows.where(F.col("suffix").isin(*SUFFIXES))


def parsed(files: DataFrame) -> DataFrame:
    """doc_id, source, text, metadata, path, error: the documents of files (path, source, suffix, stem, content), and a row with an error for each file that gives none.

    A row depends on its file alone, so that this holds for a stream of files as well."""
    body, path = F.col("body"), F.col("path")
    rows = files.select("path", "source", "suffix", "stem", _decoded("content").alias("body"))
    base = F.create_map(F.lit("file_type"), F.substring("suffix", 2, 10), F.lit("path"), path)
    item = F.struct(F.col("stem").alias("doc_id"), body.alias("text"), F.create_map().cast("map<string,string>").alias("extra"), F.lit(False).alias("numbered"))
    valid = F.get_json_object(body, "$").isNotNull()
    items = F.when(F.col("suffix") != ".json", F.array(item)).when(valid, json_items(body, F.col("stem")))
    filled = F.filter(items, lambda d: F.length(strip(F.coalesce(d["text"], F.lit("")))) > 0)
    listed = rows.select("path", "source", base.alias("base"), F.when((F.col("suffix") == ".json") & ~F.coalesce(valid, F.lit(False)), "no valid JSON").alias("broken"), F.coalesce(filled, F.array().cast(JSON_ITEMS)).alias("items"))
    each = listed.select("path", "source", "base", "broken", F.size("items").alias("n"), F.posexplode_outer("items").alias("at", "d"))
    metadata = F.map_concat("base", F.col("d.extra"))
    error = F.when(F.col("n") == 0, F.coalesce("broken", F.lit("no document with a text")))
    return each.select(F.col("d.doc_id").alias("doc_id"), "source", loader_normalise(F.col("d.text")).alias("text"), F.when(F.col("n") > 0, metadata).alias("metadata"), "path", error.alias("error"))


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc_id, source, text, metadata, path, error of the text, markdown and JSON files of a folder, or of one file.

    A file's document is named by its path below the folder, without the suffix; where two files differ by the suffix alone, with it. So ids
    are unique across folders. A file that can't be used is one row with an error; nothing else stops."""
    root = _root(spark, path)
    files = _named(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path), root)
    shared = files.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stem", F.lit(True).alias("shared"))  # names alone are read
    if n := shared.limit(FEW_NAMES + 1).count():
        files = files.join(F.broadcast(shared) if n <= FEW_NAMES else shared, "stem", "left").withColumn("stem", F.when(F.col("shared"), F.col("name")).otherwise(F.col("stem")))
    return parsed(files)


def scan_stream(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The same as a stream of the files that arrive in a folder; a document is always named with its suffix, as later files are not known."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parsed(_named(files, _root(spark, path)).withColumn("stem", F.col("name")))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Documents of files; those that can't be used are left out (see scan)."""
    return scan(spark, path, recursive).where(F.col("error").isNull() & (F.length(strip(F.col("text"))) > 0)).select("doc_id", "source", "text", "metadata")


def file_errors(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, error of the files that can't be used."""
    return scan(spark, path, recursive).where(F.col("error").isNotNull()).select("path", "error")


JSON_ITEMS = "array<struct<doc_id:string,text:string,extra:map<string,string>,numbered:boolean>>"


def json_items(body: Column, stem: Column) -> Column:
    """Documents of a JSON body: a list of objects, {"documents": [...]} or one object; content or else text; other fields become metadata."""
    kind = "array<map<string,string>>"
    listed = F.when(body.rlike(r"^\s*\["), F.from_json(body, kind)).otherwise(
        F.coalesce(F.from_json(F.get_json_object(body, "$.documents"), kind), F.array(F.from_json(body, "map<string,string>")))
    )

    def document(item: Column, i: Column) -> Column:
        field = lambda k: F.element_at(item, F.lit(k))
        text = F.coalesce(F.when(field("content") != "", field("content")), field("text"))
        extra = F.map_filter(item, lambda k, v: ~k.isin("id", "content", "text"))
        number = F.create_map(F.lit("source_item_index"), i.cast("string"))
        return F.struct(F.coalesce(field("id"), F.concat_ws("_", stem, i.cast("string"))).alias("doc_id"), text.alias("text"), F.map_concat(number, F.coalesce(extra, F.create_map().cast("map<string,string>"))).alias("extra"), F.lit(True).alias("numbered"))

    return F.transform(listed, document).cast(JSON_ITEMS)


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    return _finished(spark.createDataFrame([(f"inline_{i}", "inline", t, {}) for i, t in enumerate(texts)], SCHEMA))


def from_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Documents of dicts: content or text; id and source have defaults; other keys are metadata."""
    rows = []
    for i, item in enumerate(items):
        extra = {k: str(v) for k, v in item.items() if k not in ("id", "content", "text", "source", "metadata")}
        rows.append((str(item.get("id", f"doc_{i}")), item.get("source", "inline_list"), item.get("content") or item.get("text"), {**item.get("metadata", {}), **extra}))
    return _finished(spark.createDataFrame(rows, SCHEMA))


def from_table(table: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents of a table of any size; its other columns become metadata."""
    others = [c for c in table.columns if c not in (key, text, source)]
    metadata = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[F.col(c).cast("string") for c in others])) if others else F.create_map().cast("map<string,string>")
    return _finished(table.select(F.col(key).cast("string").alias("doc_id"), F.col(source).alias("source") if source in table.columns else F.lit("table").alias("source"), F.col(text).alias("text"), metadata.alias("metadata")))


def union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no documents given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def list_sources(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
