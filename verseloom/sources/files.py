"""Other sources and sinks: JSON records, metadata lines, run folders, tables of cached stages."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.functions.text import cache_key

WORD = "struct<text:string,start:double,end:double,confidence:double,source:string>"
TRANSCRIPT = f"words array<{WORD}>, detected_language string, duration_seconds double"


def dispatch(path: str) -> str:
    """The reader for a path: audio is generated from, archives are validated."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("mp3", "mp4"):
        return "generate"
    if suffix == "slja":
        return "validate"
    raise ValueError(f"unsupported input: {path}")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def load_json(path: str) -> dict | None:
    """A JSON object, null where there is no such file; anything else in it is an error."""
    system, at = _filesystem(path)
    if system.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(at, compression=None) as f:
        data = json.loads(f.read())
    if not isinstance(data, dict):
        raise ValueError(f"no JSON object: {path}")
    return data


def save_json(path: str, payload: dict) -> None:
    """Writes a JSON object under a name of its own and moves it to ``path``, so no reader sees half of it."""
    system, at = _filesystem(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as f:
        f.write(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode() + b"\n")
    system.move(temporary, at)


def lyrics_and_mode(text: str | None, path: str | None, mode: str | None) -> tuple[str | None, str]:
    """The expected text, given or in a file, and the mode of work: by the lyrics where there are any, else by what is heard."""
    if text is not None and path is not None:
        raise ValueError("lyrics are given twice: as a text and as a file")
    if path is not None:
        system, at = _filesystem(path)
        with system.open_input_stream(at, compression=None) as f:
            text = f.read().decode("utf-8-sig")
    mode = mode or ("asr" if text is None else "lyrics-first")
    if (mode == "lyrics-first") != (text is not None):
        raise ValueError(f"mode {mode} {'needs' if text is None else 'takes no'} lyrics")
    return text, mode


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a file; a file that is no object fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, duration): the last line of each id in JSON-lines files; a missing title is the id, a missing duration 0.

    Lines are ordered by file, block of it and place in the block, whatever the splits.
    """
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select("value", order.alias("ord"))
    rows = lines.select("ord", F.from_json("value", "id string, title string, duration double").alias("r")).select("ord", "r.*").where("id is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "duration"), "ord").alias("m"), F.min("ord").alias("seen"))
    return last.select("id", F.coalesce("m.title", "id").alias("title"), F.coalesce("m.duration", F.lit(0.0)).alias("duration"), "seen")


#: Endings of captions, the most wanted first. Fixed values.
CAPTIONS = (".pt-orig.vtt", ".pt.vtt", ".pt-BR.vtt")


def discover(spark: SparkSession, folder: str, metadata: str) -> DataFrame:
    """(id, title, duration, audio_path, caption_path, seen): metadata rows with an audio file in ``folder/id``; the first by name, and the most wanted caption, if any.

    Files are listed, not read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -2).alias("id"))
    rank = F.coalesce(*(F.when(F.col("path").endswith(e), k) for k, e in enumerate(CAPTIONS)))
    found = listed.withColumn("rank", rank).where(F.col("path").endswith(".mp3") | F.col("rank").isNotNull())
    files = found.groupBy("id").agg(F.min(F.when(F.col("rank").isNull(), F.col("path"))).alias("audio_path"), F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "path"))).alias("caption"))
    both = read_metadata(spark, metadata).join(files.where("audio_path is not null"), "id")
    return both.select("id", "title", "duration", "audio_path", F.col("caption.path").alias("caption_path"), "seen")


def snapshot(baseline: str, names: list[str], target: str) -> list[str]:
    """Copies the archives and the report of each named folder, and the reports of the folder itself, under ``target``; missing ones are left out."""
    system, root = _filesystem(baseline)
    out, to = _filesystem(target)
    copied = []
    wanted = {"": (".md", ".json", ".jsonl", ".txt"), **{f"/{n}": (".slja", "consensus-report.md") for n in names}}
    for folder, endings in wanted.items():
        for info in sorted(system.get_file_info(pafs.FileSelector(root + folder, allow_not_found=True)), key=lambda f: f.path):
            if info.type == pafs.FileType.File and info.path.endswith(endings):
                out.create_dir(to + folder, recursive=True)
                pafs.copy_files(info.path, f"{to}{folder}/{info.base_name}", source_filesystem=system, destination_filesystem=out)
                copied.append(f"{folder}/{info.base_name}".lstrip("/"))
    return copied


def tree_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files under a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_run(df: DataFrame, root: str, phase: int, run_id: str) -> str:
    """Writes an immutable run and its manifest; an existing run id is an error."""
    path = f"{root}/phase={phase}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    save_json(f"{root}/manifests/phase-{phase}-{run_id}.json", {"phase": phase, "run_id": run_id, "rows": rows, "columns": dict(df.dtypes), "path": path})
    return path


def cached_stage(inputs: DataFrame, cache: DataFrame | None, key: str, variant: str, compute) -> DataFrame:
    """(key, variant, payload) of all inputs: from the cache where it has them, computed where it has not.

    ``compute`` takes the missing inputs and returns (key, payload).
    """
    tagged = inputs.withColumn("variant", cache_key(F.lit(variant)))
    if cache is None:
        return compute(tagged).withColumn("variant", cache_key(F.lit(variant)))
    hits = cache.join(tagged.select(key, "variant"), [key, "variant"], "left_semi").select(key, "variant", "payload")
    missing = tagged.join(cache.select(key, "variant"), [key, "variant"], "left_anti")
    return hits.unionByName(compute(missing).withColumn("variant", cache_key(F.lit(variant))).select(key, "variant", "payload"))
