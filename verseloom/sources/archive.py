"""The slide archive (a ZIP with a CP1252 section text and an audio file) as a Python Data Source.

``spark.read.format("slide_archive").load(path)`` gives a row a slide of every archive under a path;
``df.write.format("slide_archive").mode("append").save(folder)`` writes one archive for each row of
(name, lja, audio binary); the audio gets the name that the section text gives it. Files are opened by their URI, each task its own, and written under a
temporary name that a rename replaces, so no reader sees half an archive.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from verseloom.config import TICK_RATE
from verseloom.runtime import send_code

#: Names within the archive. Fixed values.
MEMBER, SUFFIX = "slides.lja", ".slja"
SCHEMA = "path string, title string, audio_member string, slide_idx int, lines array<string>, start_seconds double, aux_text string"


def seconds(text: str, tick_rate: float = TICK_RATE) -> float:
    """Of HH:MM:SS, of ticks (whole numbers over 10000) or of plain seconds."""
    text = text.strip()
    if not text:
        return 0.0
    if ":" in text:
        h, m, s = (float(p) for p in text.split(":"))
        return h * 3600 + m * 60 + s
    return float(text) / tick_rate if text.isdigit() and int(text) > 10_000 else float(text)


def sections(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Sections in order; the last of equal keys wins, keys before any section drop."""
    name, values = None, {}
    for line in text.removeprefix("﻿").splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            if name is not None:
                yield name, values
            name, values = line[1:-1], {}
        elif "=" in line and name is not None:
            key, _, value = line.partition("=")
            values[key.strip()] = value.strip()
    if name is not None:
        yield name, values


def slides_of_archive(data: bytes) -> tuple[str, str, list[tuple[list[str], float, str]]]:
    """Title, audio member and slides (lines, start, aux)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = z.read(MEMBER).decode("cp1252", errors="replace")
    title = audio = ""
    slides = []
    for name, v in sections(text):
        if name == "Geral":
            audio = v.get("url_musica") or v.get("audio") or ""
        elif name.startswith("Slide:") and v.get("tipo") == "CAPA":
            title = v.get("letra", "")
        elif name.startswith("Slide:") and v.get("tipo") == "LETRA":
            slides.append(([p.strip() for p in v.get("letra", "").split("|") if p.strip()], seconds(v.get("tempo", "0")), v.get("letra_aux", "").strip()))
    return title, audio, slides


def audio_member(lja: str) -> str:
    """The audio file that a section text names."""
    named = (v.get("url_musica") or v.get("audio") for name, v in sections(lja) if name == "Geral")
    return next((n for n in named if n), "audio\\audio.mp3")


def archive_bytes(lja: str, audio: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MEMBER, lja.encode("cp1252", errors="replace"))
        z.writestr(audio_member(lja), audio)
    return out.getvalue()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(SUFFIX)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_stream(partition.path, compression=None) as f:
            title, audio, slides = slides_of_archive(f.read())
        for k, (lines, start, aux) in enumerate(slides):
            yield partition.path, title, audio, k, lines, start, aux


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        for r in rows:
            temporary = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary, compression=None) as f:
                f.write(archive_bytes(r.lja, bytes(r.audio or b"")))
            system.move(temporary, f"{root}/{r.name}{SUFFIX}")
        return WriterCommitMessage()


class SlideArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    send_code(spark)
    spark.dataSource.register(SlideArchive)
