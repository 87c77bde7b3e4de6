"""Sources and sinks: user rows, run folders, columnar cohorts, signed documents."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.corpus import merkle_root, validate_rows

USER_SCHEMA = "text string, label string, family string, kind string, `group` string, author string, domain string, source string"
LEAST_ROWS = 8


def read_user_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV or JSONL file with ``y`` and ``problem``; the group is the row's group, else its
    source, else its own. Malformed lines come out with their problem instead of failing the read."""
    schema = USER_SCHEMA + ", _corrupt string"
    if path.endswith(".csv"):
        df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").csv(path)
    else:
        df = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
    df = validate_rows(df).withColumn("problem", F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise(F.col("problem"))).drop("_corrupt")
    own = F.concat(F.lit("row-"), F.substring(F.sha2(F.concat_ws(" ", "text", "label"), 256), 1, 16))
    return df.withColumn("group", F.coalesce("group", "source", own)).fillna({"family": "unknown", "kind": "text"})


def accept(df: DataFrame) -> DataFrame:
    """The sound rows; raises where a row has a problem or there are fewer than eight."""
    n = {r["problem"]: r["n"] for r in df.groupBy("problem").agg(F.count("*").alias("n")).collect()}
    bad = {k: v for k, v in n.items() if k}
    if bad or n.get(None, 0) < LEAST_ROWS:
        raise ValueError(f"rows with problems: {bad}; sound rows: {n.get(None, 0)}")
    return df.drop("problem")


def read_cohort(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A columnar cohort; columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_outputs(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(run_id, file, text, sha256, bytes)`` of the text files under a folder; the run is the folder that a
    file lies in."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return df.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("file"), F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_manifests(spark: SparkSession, folder: str, pattern: str = "manifest.json") -> DataFrame:
    """``(run_id, file, sha256, bytes, merkle_root, sound)``: a row per output that a run's manifest names;
    ``sound`` tells whether the manifest's own hash is that of its content."""
    docs = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)

    @F.udf("boolean")
    def is_sound(text):
        try:
            return verify(json.loads(text))
        except (ValueError, AttributeError):
            return False

    m = docs.select(is_sound("value").alias("sound"), F.from_json("value", "run_id string, merkle_root string, outputs array<struct<file string, sha256 string, bytes bigint>>").alias("m"))
    return m.select("m.run_id", "m.merkle_root", "sound", F.explode("m.outputs").alias("o")).select("run_id", "o.file", "o.sha256", "o.bytes", "merkle_root", "sound")


def verified_runs(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(run_id, verified)``: the manifest is as it was signed (column ``sound``, where there is one), all files
    of a run are there with its hash and size, and their Merkle root is the manifest's. ``manifest``:
    run_id, file, sha256, bytes, merkle_root. A single folder of outputs may have any name."""
    sound = F.col("sound") if "sound" in manifest.columns else F.lit(True)
    m = manifest.select("run_id", "file", F.col("sha256").alias("want"), F.col("bytes").alias("size"), "merkle_root", sound.alias("sound"))
    on = ["run_id", "file"] if "run_id" in outputs.columns and manifest.select("run_id").distinct().limit(2).count() > 1 else ["file"]
    j = m.join(outputs.select(*on, "sha256", "bytes"), on, "left")
    ok = F.coalesce((F.col("sha256") == F.col("want")) & (F.col("bytes") == F.col("size")), F.lit(False))
    g = j.groupBy("run_id").agg(F.bool_and(ok & F.col("sound")).alias("files"), F.collect_list("want").alias("h"), F.max("merkle_root").alias("root"))
    return g.select("run_id", (F.col("files") & (merkle_root(F.col("h")) == F.col("root"))).alias("verified"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of a folder's verified runs, each checked against the manifest beside it."""
    m, o = read_manifests(spark, folder), read_outputs(spark, folder)
    return o.join(verified_runs(o, m).where("verified"), "run_id", "left_semi")


def combine(named: dict[str, DataFrame]) -> DataFrame:
    """Union of cohorts with a dataset column; groups are prefixed so that they stay apart."""
    out = None
    for name, df in named.items():
        d = df.withColumn("group", F.concat(F.lit(f"{name}:"), F.col("group"))).withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def canonical_hash(document: dict) -> str:
    body = {k: v for k, v in document.items() if k != "artifact_sha256"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sign(document: dict) -> dict:
    return {**document, "artifact_sha256": canonical_hash(document)}


def verify(document: dict) -> bool:
    return document.get("artifact_sha256") == canonical_hash(document)


def write_signed(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(sign(document), f, sort_keys=True, indent=2, ensure_ascii=False)


def write_cohort(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """Cohort as Parquet, or gzipped JSON lines (``form="json"``)."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    w.option("compression", "gzip" if form == "json" else "zstd").format(form).save(path)


def decode_upload(data: Column) -> Column:
    """Bytes of a base64 text; null where it is none."""
    return F.try_to_binary(data, F.lit("base64"))


#: File types that can carry a content-credential manifest.
MANIFEST_TYPES = ("jpg", "jpeg", "png", "webp", "gif", "tif", "tiff", "avif", "heic", "mp4", "mov", "m4a", "mp3", "wav", "pdf")


def provenance_status(content: Column, filename: Column) -> Column:
    """``not_applicable`` without content, ``unsupported_file`` by the extension, ``unverified`` where a manifest
    is named in the bytes, which needs a reader to verify, else ``not_present``."""
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.when(content.isNull(), "not_applicable").when(~F.coalesce(ext.isin(*MANIFEST_TYPES), F.lit(False)), "unsupported_file").when(provenance_marks(content), "unverified").otherwise("not_present")


def provenance_marks(content: Column) -> Column:
    """Whether the first 2,000,000 bytes name a content-credential manifest."""
    return F.lower(F.decode(F.substring(content, 1, 2_000_000), "iso-8859-1")).rlike("c2pa|contentcredentials")


def read_tar(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``(archive, member, content)`` of the members of tar archives whose name fits a pattern; an archive is unpacked by
    one task, member by member."""
    import fnmatch
    import io
    import tarfile

    def unpack(batches):
        import pandas as pd

        for b in batches:
            for archive, data in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile() and fnmatch.fnmatch(m.name.rsplit("/", 1)[-1], pattern):
                            yield pd.DataFrame({"archive": [archive], "member": [m.name], "content": [t.extractfile(m).read().decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, content string")


def read_bundles(folder: str, required: tuple[str, ...] = ("bundle_id", "metrics"), allowed: tuple[str, ...] | None = None) -> dict[str, dict]:
    """Signed JSON documents of a folder by ``bundle_id``: those that are named in ``allowed``, have the required keys and
    hash to what they say; others are left out."""
    out = {}
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".json"):
            continue
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                d = json.load(f)
        except ValueError:
            continue
        if isinstance(d, dict) and all(k in d for k in required) and verify(d) and (allowed is None or d["bundle_id"] in allowed):
            out[d["bundle_id"]] = d
    return out


def validate_document(document: dict, schema: dict) -> list[str]:
    """Problems of a signed document: keys that are missing or of another type than ``schema`` (key to type) says, and a
    hash that isn't that of the content."""
    found = [f"{k} is missing" for k in schema if k not in document]
    found += [f"{k} is no {t.__name__}" for k, t in schema.items() if k in document and not isinstance(document[k], t)]
    return found + ([] if verify(document) else ["the hash is not that of the content"])


def reproduced(expected: dict[str, float], found: dict[str, float], tolerance: float = 1e-6) -> dict[str, tuple[float, float | None]]:
    """Metrics whose recomputed value is absent or further from the expected one than ``tolerance``."""
    return {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) is None or abs(found[k] - v) > tolerance}


def append_registry(entry: dict, path: str) -> None:
    """Appends a signed entry to a registry of JSON lines; an entry whose ``run_id`` it has already is refused."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if any(json.loads(line).get("run_id") == entry.get("run_id") for line in f if line.strip()):
                raise ValueError(f"run {entry.get('run_id')!r} is registered already")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(sign(entry), sort_keys=True, ensure_ascii=False) + "\n")
