"""The archive's section text: a scanner and a renderer, both row by row in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions import text as X
from verseloom.functions.timecode import clock

#: Fixed values of the archive format.
VERSION = "25.0.17424.39578"
COVER_IMAGE, SLIDE_IMAGE = "imagens\\Capa.jpg", "imagens\\slides.jpg"
TEXT_STYLE = ("fundo_letra=1", "tamanho_letra=20", "cor_letra=#FFFFFF", "cor_fundo=#000000")
AUX_STYLE = ("tamanho_letra_aux=10", "cor_letra_aux=#EFB400")


def parse_sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, section, name, value): the last of equal names in a section wins; names before any section drop."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, "^\\uFEFF", ""), r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    head = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    is_head = F.col("line").rlike(r"^\[.*\]$")
    marked = lines.withColumn("section_no", F.sum(is_head.cast("int")).over(w)).withColumn("section", F.last(F.when(is_head, head), True).over(w))
    pairs = marked.where(~is_head & F.col("line").contains("=") & F.col("section").isNotNull())
    at = F.instr("line", "=")
    named = pairs.select(key, "section_no", "section", "pos", F.trim(F.left("line", at - 1)).alias("name"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value"))
    return named.groupBy(key, "section_no", "section", "name").agg(F.max_by("value", "pos").alias("value"))


def slides_of(sections: DataFrame, key: str) -> DataFrame:
    """(key, section_no, kind, text, aux, time): one row a section of a slide."""
    pick = lambda n: F.max(F.when(F.lower("name") == n, F.col("value")))
    return sections.groupBy(key, "section_no", "section").agg(pick("tipo").alias("kind"), pick("letra").alias("text"), pick("letra_aux").alias("aux"), pick("tempo").alias("time"))


def _section(number: Column, kind: str, text: Column, aux: Column, time: Column, image: str) -> Column:
    """One section of the archive text, its lines ended by CRLF and a blank line after it."""
    parts = [
        F.concat(F.lit("[Slide:"), number.cast("string"), F.lit("]")),
        F.lit(f"tipo={kind}"),
        F.concat(F.lit("letra="), text),
        F.lit("\r\n".join(TEXT_STYLE)),
        F.when(aux != "", F.concat(F.lit("letra_aux="), aux)),  # concat_ws leaves nulls out
        F.lit("\r\n".join([*AUX_STYLE, f"imagem={image}", "imagem_posicao=5"])),
        F.concat(F.lit("tempo="), time),
    ]
    return F.concat(F.concat_ws("\r\n", *parts), F.lit("\r\n\r\n"))


def render_sections(slides: DataFrame, key: str, title: str, audio: str | None = None) -> DataFrame:
    """(key, lja): the section text of a key's slides (slide_idx, lines, start_seconds, aux_text), a cover first.

    CRLF lines; a bar joins a slide's lines; an aux line only where there is one. A trailing blank line goes.
    """
    order = F.row_number().over(Window.partitionBy(key).orderBy("slide_idx")) + 1
    text = F.array_join(F.transform("lines", X.archive_value), "|")
    aux = X.archive_value(F.coalesce("aux_text", F.lit("")))
    name = X.safe_filename(F.col(audio)) if audio else F.lit("audio.mp3")
    made = slides.select(key, F.col(title).alias("title"), name.alias("audio"), order.alias("n"), text.alias("letra"), aux.alias("aux"), clock(F.col("start_seconds")).alias("time"))
    made = made.withColumn("body", _section(F.col("n"), "LETRA", F.col("letra"), F.col("aux"), F.col("time"), SLIDE_IMAGE))
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "")
    head = F.concat(F.lit("[Geral]\r\nslides="), (F.col("count") + 1).cast("string"), F.lit(f"\r\nversao={VERSION}\r\nurl_musica=audio\\"), F.col("audio"), F.lit("\r\naudio=1\r\n\r\n"))
    cover = _section(F.lit(1), "CAPA", X.archive_value(F.col("title")), F.lit(""), F.lit("00:00:00"), COVER_IMAGE)
    out = made.groupBy(key, "title", "audio").agg(bodies.alias("bodies"), F.count(F.lit(1)).alias("count"))
    return out.select(key, F.regexp_replace(F.concat(head, cover, "bodies"), "\r\n\r\n$", "\r\n").alias("lja"))
