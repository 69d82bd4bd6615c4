"""Scans and sinks of nodes, corpora, images and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.parsing import corpus_text
from hopweave.functions.text import first_of, rewrite_path, strip
from hopweave.operators.vector import normalize_corpus
from hopweave.sources.json_array import scan_array
from hopweave.storage import checkpointed

ALLOWED = ("json", "jpg", "jpeg", "png")
#: Media types by suffix; what has none is taken for JPEG.
MIME = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
#: Suffixes tried in turn for an image path without one.
IMAGE_SUFFIXES = ("", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Raw corpus files of a folder (path, content), by case-sensitive suffix; dotfiles are skipped."""
    files = spark.read.format("binaryFile").load(folder)
    name = file_name(F.col("path"))
    return files.where(~F.startswith(name, F.lit("."))).where(F.regexp_extract(name, r"\.([^.]+)\z", 1).isin(*ALLOWED)).select("path", "content")


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose stem is not among the outputs' stems."""
    return inputs.withColumn("stem", stem(F.col("path"))).join(done.select(stem(F.col("path")).alias("stem")).distinct(), "stem", "left_anti")


def load_texts(files: DataFrame) -> DataFrame:
    """JSON text files to (path, text); malformed and blank ones are dropped."""
    text = corpus_text(F.col("content").cast("string"))
    return files.where(F.endswith("path", F.lit(".json"))).select("path", text.alias("text")).where(F.coalesce(strip(F.col("text")), F.lit("")) != "")


def scan_nodes(spark: SparkSession, folder: str, data_root: str | None = None, pattern: str = "*.node") -> DataFrame:
    """Node files (an object or a list of objects each) as (id, text, modality, image_path, file_path, embedding, metadata).

    Unreadable files give no rows, items that are no objects are skipped, and nodes without a vector are dropped.
    """
    raw = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    node = raw.where("v is not null").select("path", F.explode(items).alias("n")).where(F.startswith(F.schema_of_variant("n"), F.lit("OBJECT")))
    get = lambda p, t="string": F.try_variant_get("n", p, t)
    path = lambda p: rewrite_path(first_of(get(f"$.{p}"), get(f"$.metadata.{p}")), data_root) if data_root else first_of(get(f"$.{p}"), get(f"$.metadata.{p}"))
    nested = lambda p: F.startswith(F.schema_of_variant(get(f"$.{p}", "variant")), F.lit("ARRAY<ARRAY"))
    vector = lambda p: F.when(nested(p), F.flatten(get(f"$.{p}", "array<array<float>>"))).otherwise(get(f"$.{p}", "array<float>"))
    image = first_of(path("image_path"), get("$.image_resource.path"))
    rows = node.select(
        first_of(get("$.id"), get("$.metadata.id"), stem(F.col("path"))).alias("id"), F.coalesce(first_of(get("$.text"), get("$.content")), F.lit("")).alias("text"),
        image.alias("image_path"), path("file_path").alias("file_path"), F.coalesce(vector("vector"), vector("embedding")).alias("embedding"), get("$.metadata", "variant").alias("metadata"),
    )
    rows = rows.where("embedding is not null and size(embedding) > 0")
    return rows.withColumn("embedding", normalize_corpus(F.col("embedding")).cast("array<float>")).withColumn("modality", modality(F.col("image_path"), F.col("file_path"), F.col("metadata")))


def modality(image_path: Column, file_path: Column, metadata: Column) -> Column:
    """image, where an image path is known or the metadata or file name says so; else text."""
    said = F.try_variant_get(metadata, "$.data_type", "string")
    looks = F.coalesce(file_path, F.lit("")).rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)\z")
    return F.when((F.coalesce(image_path, F.lit("")) != "") | F.coalesce(said == "image", F.lit(False)) | looks, "image").otherwise("text")


def split_modalities(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text documents (those with text) and images."""
    return nodes.where("modality = 'text' and text <> ''"), nodes.where("modality = 'image'")


def scan_legacy(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file with text_corpus (or corpus), image_corpus and audio_corpus as one table with a modality; one file is read by many tasks.

    ``corpus`` counts in files that have no ``text_corpus`` with elements.
    """
    found = checkpointed(scan_array(spark, path), "legacy").where("field in ('text_corpus', 'corpus', 'image_corpus', 'audio_corpus')")
    newer = found.where("field = 'text_corpus'").select("path").distinct().withColumn("newer", F.lit(True))
    found = found.join(newer, "path", "left").where("field <> 'corpus' or newer is null")
    out = found.select(F.when(F.col("field") == "corpus", "text").otherwise(F.regexp_replace("field", "_corpus$", "")).alias("modality"), F.try_parse_json("element").alias("n")).where("n is not null")
    get = lambda p: F.try_variant_get("n", p, "string")
    return out.select("modality", get("$.id").alias("id"), first_of(get("$.text"), get("$.description")).alias("text"), get("$.image_path").alias("image_path"), F.try_variant_get("n", "$.metadata", "variant").alias("metadata"))


def write_nodes(nodes: DataFrame, path: str, mode: str = "append") -> None:
    """The node table as Parquet; its dimension is part of the partition, so no two models' vectors mix."""
    nodes.withColumn("dim", F.size("embedding")).write.mode(mode).partitionBy("dim").parquet(path)


def read_nodes(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dim") == dim).drop("dim")


def write_corpora_json(nodes: DataFrame, path: str) -> None:
    """The corpora as JSON lines, one folder per modality."""
    nodes.withColumn("metadata", F.to_json("metadata")).write.mode("overwrite").partitionBy("modality").json(path)


def data_uri(path: Column, content: Column) -> Column:
    """An image as a data URI, its media type by suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)\z", 1))
    mime = F.lit("image/jpeg")
    for k, m in MIME.items():
        mime = F.when(suffix == k, m).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def encode_images(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Paths (image_path) to data URIs: the path itself, then with each known suffix, first found wins; absent ones are null."""
    tries = wanted.select("image_path", F.posexplode(F.transform(F.array(*map(F.lit, IMAGE_SUFFIXES)), lambda s: F.concat("image_path", s))).alias("turn", "path"))
    found = tries.join(files.select("path", data_uri(F.col("path"), F.col("content")).alias("uri")), "path").groupBy("image_path").agg(F.min_by("uri", "turn").alias("uri"))
    return wanted.join(found, "image_path", "left")


def thumbnails(files: DataFrame, side: int = 1024, quality: int = 85) -> DataFrame:
    """JPEG thumbnails as data URIs, where Pillow is installed; null for what can't be decoded."""

    def shrink(batches):
        import base64
        import io

        try:
            from PIL import Image
        except ImportError:
            Image = None
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    picture = Image.open(io.BytesIO(raw)).convert("RGB")
                    picture.thumbnail((side, side))
                    buffer = io.BytesIO()
                    picture.save(buffer, "JPEG", quality=quality)
                    out.append("data:image/jpeg;base64," + base64.b64encode(buffer.getvalue()).decode())
                except Exception:  # noqa: BLE001 - an undecodable image is a null, whatever the decoder says
                    out.append(None)
            yield pdf[["path"]].assign(uri=out)

    return files.select("path", "content").mapInPandas(shrink, "path string, uri string")


def scan_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation samples: ``{"examples": [...]}`` or a bare list; in file order, the first ``limit``. An absent file gives one dummy row."""
    schema = (
        "struct<uid:string,query:string,question:string,context:string,images:array<string>,is_multi_hop:boolean,reference_answer:string,"
        "ground_truth:struct<answer:string>,answer:string,target:string,output:string,meta_info:struct<query_type:string,source_type:string>>"
    )
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.range(1).select(F.lit(0).cast("long").alias("ord"), F.from_json(F.lit('{"uid": "dummy", "query": "What is shown?", "reference_answer": ""}'), schema).alias("s")).select("ord", "s.*")
    items = scan_array(spark, path).where("field in ('', 'examples')")
    items = items.where(F.col("ord") < limit) if limit else items
    return items.select("ord", F.try_variant_get(F.try_parse_json("element"), "$", schema).alias("s")).select("ord", "s.*").orderBy("ord")


def sample_key(uid: Column, query: Column) -> Column:
    """What a sample is resumed by: its uid, else its query."""
    return first_of(uid, query)


def resume(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples that have no result yet."""
    key = sample_key(F.col("uid"), F.col("query"))
    return samples.withColumn("key", key).join(done.select(sample_key(F.col("uid"), F.col("query")).alias("key")).distinct(), "key", "left_anti")


def append_jsonl(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written as JSON lines; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def normalise_questions(df: DataFrame) -> DataFrame:
    """Old questions (query, image_path) and new ones (question, information) in one shape; other columns pass."""
    cols = df.columns
    question = first_of(*(F.col(c) for c in ("question", "query") if c in cols))
    images = [c for c in (F.col("information.images") if "information" in cols else None, F.array_compact(F.array("image_path")) if "image_path" in cols else None) if c is not None]
    text = F.col("information.text") if "information" in cols else F.lit("")
    info = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(*images, F.array().cast("array<string>")).alias("images"))
    return df.select(*(c for c in cols if c not in ("question", "query", "image_path", "information")), question.alias("question"), info.alias("information"))


def rejects(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required columns, and the rest with the names of what they lack."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required)))
    tagged = df.withColumn("missing", missing)
    return tagged.where("size(missing) = 0").drop("missing"), tagged.where("size(missing) > 0")


def write_records(records: DataFrame, path: str) -> None:
    """Similarity records as JSON, replacing what was there."""
    records.write.mode("overwrite").json(path)
