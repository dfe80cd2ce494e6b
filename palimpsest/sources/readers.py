"""Readers of collection files, corpora and logs."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.runtime import ship
from .archives import COMPANIONS, ROW, Archive, rows_of
from .ledger import Ledger

def read_archives(spark: SparkSession, folder: str, pattern: str = "*.npz") -> DataFrame:
    """All archives of a folder, a task a file; the store only needs to be one that Spark reads.

    Where Arrow opens the store too, the data source patterns_npz (archives.Archives) reads files in ranges.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    for c in COMPANIONS:
        files = files.filter(~F.col("path").endswith(c))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ROW.split(", ")]
        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows: list[tuple] = []
                for r in rows_of(path.rsplit("/", 1)[-1].removesuffix(".npz").removesuffix(".cart"), content):
                    rows.append(r)
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ROW)


def find_collections(spark: SparkSession, folders: list[str]) -> DataFrame:
    """name, path, size_mb of the files in the folders; of equal names the first folder's."""
    out = None
    for i, d in enumerate(folders):
        f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{npz,pkl,parquet}").load(d).select("path", (F.col("length") / 1e6).alias("size_mb"), F.lit(i).alias("_order"))
        out = f if out is None else out.unionAll(f)
    for c in COMPANIONS:
        out = out.filter(~F.col("path").endswith(c))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.cart)?\.(npz|pkl|parquet)$", "")
    own = Window.partitionBy("name").orderBy("_order", "path")
    return out.withColumn("name", name).withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n", "_order")


def mount_ids(files: DataFrame) -> DataFrame:
    """files (path) with ids of folder and name; ids that come again get _1, _2 and so on."""
    parts = F.split("path", "/")
    base = F.concat(F.element_at(parts, -2), F.lit("_"), F.regexp_replace(F.element_at(parts, -1), r"(\.cart)?\.[a-z]+$", ""))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("path")) - 1
    return files.withColumn("_base", base).withColumn("_n", n).withColumn("collection", F.when(F.col("_n") > 0, F.concat("_base", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def read_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """source, text of the text, Markdown and JSON files of a folder that are not blank, by name.

    JSON lists and JSON lines give their items' text or content, joined by passage breaks; a
    line that is no JSON is text itself.
    """
    files = spark.read.option("pathGlobFilter", "*.{txt,md,json,jsonl}").option("recursiveFileLookup", str(recursive).lower()).text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    item = "struct<text:string,content:string>"
    of = lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["content"])
    listed = F.from_json("value", f"array<{item}>", {"mode": "PERMISSIVE"})
    plain = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    field = lambda x, name: F.nullif(F.get_json_object(x, f"$.{name}"), F.lit(""))
    line = F.transform(lines, lambda x: F.coalesce(field(x, "text"), field(x, "content"), F.trim(x)))
    items = F.coalesce(F.nullif(F.array_join(F.transform(listed, of), f"\n\n{T.BREAK}\n\n"), F.lit("")), F.array_join(plain, f"\n\n{T.BREAK}\n\n"), F.col("value"))
    text = F.when(F.col("path").endswith(".jsonl"), F.array_join(line, f"\n\n{T.BREAK}\n\n")).when(F.col("path").endswith(".json"), items).otherwise(F.col("value"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), text.alias("text")).filter(F.length(T.strip(F.col("text"))) > 0)


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Learning entries of JSON lines (broken ones dropped), of a JSON list, or of one under entries or learning_entries."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    raw = spark.read.text(path, wholetext=True)
    item = f"array<struct<{schema}>>"
    held = F.from_json("value", f"struct<learning_entries:{item},entries:{item}>")
    return raw.select(F.inline(F.coalesce(held["learning_entries"], held["entries"], F.from_json("value", item))))


def read_machines(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The entries of all <root>/<machine>/*_learning.jsonl with their machine."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root}/*/*_learning.jsonl")
    return rows.withColumn("machine", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]*_learning\.jsonl", 1))


def read_ir(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (id, title, text), queries (id, text) that have judgements, judgements (query, idx, grade > 0)."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "id")
    judged = spark.read.option("sep", "\t").option("header", "true").csv(f"{root}/qrels/{split}.tsv").toDF("query", "idx", "grade").withColumn("grade", F.col("grade").cast("int")).filter("grade > 0")
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").withColumnRenamed("_id", "id")
    return corpus, queries.join(judged.select(F.col("query").alias("id")), "id", "left_semi"), judged


def write_collections(patterns: DataFrame, path: str, mode: str = "append") -> None:
    """Patterns by collection, so that a search of some reads no others."""
    patterns.write.mode(mode).partitionBy("collection").parquet(path)


def append_collection(spark: SparkSession, rows: DataFrame, path: str, agent: str = "") -> int:
    """Appends rows to a stored collection, a ledger of commits; gives the commit's number.

    Rows without metadata get empty ones. What is there is neither written nor read again: the
    manifest is merged out of the commits (Ledger.manifest).
    """
    if "meta" in rows.columns:
        rows = rows.withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))
    return Ledger(spark, path).append(rows, agent)


def signatures_of(content: bytes) -> Iterator[tuple]:
    """idx, signature, title and text of a signature file; what it lacks is null. Pickled arrays are refused."""
    a = Archive(io.BytesIO(content))
    n = min(int(a.value("n_patterns")) if "n_patterns" in a else len(a["signatures"]), len(a["signatures"]))
    for at in range(0, n, 2000):
        to = min(at + 2000, n)
        rows = a["signatures"].rows(at, to)
        texts = a.texts(at, to) if "compressed_texts" in a else []
        titles = [str(t) for t in a["titles"].rows(at, to)] if "titles" in a else []
        for i in range(to - at):
            yield at + i, [float(x) for x in rows[i]], titles[i] if i < len(titles) else None, texts[i] if i < len(texts) else None


def read_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """collection, idx, signature, title, text of all signature files below a folder."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_signatures.npz").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1].removesuffix("_signatures.npz")
                yield pd.DataFrame([(name, *r) for r in signatures_of(content)], columns=["collection", "idx", "signature", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "collection string, idx long, signature array<float>, title string, text string")


def write_manifest(manifests: DataFrame, path: str) -> None:
    """Manifests as JSON, put in place of those there by one rename: readers see the old ones or the new."""
    spark = manifests.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    manifests.write.json(fresh)
    jvm = spark.sparkContext._jvm
    to, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{fresh}.old"))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(to)
    if had:
        files.rename(to, old)
    files.rename(new, to)
    if had:
        files.delete(old, True)
