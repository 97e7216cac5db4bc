"""Chunking inside one row: a document becomes an array of chunks, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import constants as K
from .citations import article_header
from .text import strip


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = K.MAX_CHARS
    overlap_chars: int = K.OVERLAP_CHARS
    min_chars: int = K.MIN_CHARS
    use_law_structure: bool = True


def split_sections(text: Column) -> Column:
    """Cut before every titled article; a text without one is a single section."""
    pieces = F.split(text, f"(?={K.SECTION_HEAD}{K.SECTION_TITLE})", -1)
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def split_sentences(section: Column) -> Column:
    pieces = F.split(section, f"(?<={K.SENTENCE_ENDS}){K.S}+", -1)
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def assemble(sentences: Column, cfg: ChunkConfig) -> Column:
    """Greedy packing with overlap as a fold over (finished chunks, open buffer)."""

    def step(acc, sent):
        out, buf = acc["out"], acc["buf"]
        over = (buf != "") & (F.length(buf) + F.length(sent) + 1 > cfg.max_chars)
        carried = F.substring(buf, -cfg.overlap_chars, cfg.overlap_chars) if cfg.overlap_chars else F.lit("")
        lead = F.when(over, carried).otherwise(buf)
        return F.struct(
            F.when(over & (F.length(buf) >= cfg.min_chars), F.array_append(out, strip(buf)))
            .otherwise(out)
            .alias("out"),
            F.when(lead == "", sent).otherwise(F.concat(lead, F.lit(" "), sent)).alias("buf"),
        )

    def finish(acc):
        tail = strip(acc["buf"])
        keep = (tail != "") & (F.length(tail) >= cfg.min_chars)
        return F.when(keep, F.array_append(acc["out"], tail)).otherwise(acc["out"])

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    return F.aggregate(sentences, start, step, finish)


def chunk_section(
    section: Column, cfg: ChunkConfig, splitter: Callable[[Column], Column] = split_sentences
) -> Column:
    """Chunks of one section. A short section is packed whole, without a sentence split."""
    short = F.length(section) <= cfg.max_chars
    whole = F.filter(F.array(section), lambda s: F.length(s) >= cfg.min_chars)
    return F.when(short, whole).otherwise(assemble(splitter(section), cfg))


def chunk_array(text: Column, cfg: ChunkConfig = ChunkConfig(), detect: bool = True,
                splitter: Callable[[Column], Column] = split_sentences) -> Column:
    """``array<struct(article, text)>`` in document order; the position is the chunk index."""
    if detect:
        sections = split_sections(text)
    else:
        sections = F.filter(F.array(strip(text)), lambda s: s != "")

    def chunks_of(section):
        article = article_header(section) if detect else F.lit("")
        # zip_with evaluates the header once per section, not once per chunk
        cut = chunk_section(section, cfg, splitter)
        return F.struct(article.alias("article"), cut.alias("texts"))

    per_section = F.transform(sections, chunks_of)
    return F.flatten(
        F.transform(
            per_section,
            lambda s: F.transform(s["texts"], lambda t: F.struct(s["article"].alias("article"), t.alias("text"))),
        )
    )


def sample_array(chunks: Column, n: int = K.SAMPLE_CHUNKS) -> Column:
    """At most ``n`` chunks: all of a short list, else 40 % front, 20 % middle, 40 % back."""
    front, middle = max(1, n * 4 // 10), max(1, n * 2 // 10)
    back = n - front - middle
    total = F.size(chunks)
    start = F.floor(total / 2) - middle // 2
    start = F.greatest(F.lit(front), F.least(start, total - back - middle)).cast("int")
    parts = [F.slice(chunks, 1, front), F.slice(chunks, start + 1, middle)]
    if back > 0:
        parts.append(F.slice(chunks, total - back + 1, back))
    return F.when(total <= n, chunks).otherwise(F.array_distinct(F.concat(*parts)))


def sample_text(chunks: Column, budget: int = K.SAMPLE_TEXT_CHARS) -> Column:
    """Labelled chunk texts up to a character budget; stops before the part that exceeds it."""

    def step(acc, c):
        part = F.concat(F.lit("[청크 "), c["chunk_index"].cast("string"), F.lit("]\n"), c["text"])
        total = acc["total"] + F.length(part)
        fits = ~acc["full"] & (total <= budget)
        return F.struct(
            F.when(fits, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"),
            F.when(fits, total).otherwise(acc["total"]).alias("total"),
            (~fits).alias("full"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).alias("total"), F.lit(False).alias("full")
    )
    return F.aggregate(chunks, start, step, lambda acc: F.array_join(acc["parts"], "\n\n"))
