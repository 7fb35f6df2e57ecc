"""Chunking of texts: by words (all built-in expressions), by sentences and by Markdown structure."""

from __future__ import annotations

import re
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError

TOKENS_A_WORD, TOKENS_A_CHAR = 1.3, 0.25


def chunk_by_tokens(df: DataFrame, max_tokens: int, overlap: int = 0, separator: str = " ", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_no, chunk): runs of floor(max_tokens / 1.3) words (one at least), overlapping by floor(overlap / 1.3).

    Words are parted by ASCII white space. Null, empty and blank texts have no chunk.
    """
    if max_tokens < 1 or overlap < 0:
        raise ValidationError("max_tokens must be positive and overlap not negative")
    size = max(1, floor(max_tokens / TOKENS_A_WORD))
    step = size - floor(overlap / TOKENS_A_WORD)
    step = step if step > 0 else size
    words = df.select(F.col(key).alias("doc_id"), F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    chunks = words.select("doc_id", "w", F.posexplode(starts).alias("chunk_no", "s"))
    return chunks.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("s") + 1, F.lit(size)), separator).alias("chunk"))


#: A sentence ends after terminal marks, closing quotes or brackets and white space, if no lower-case letter follows, or at a line's end.
_SENTENCE = re.compile(r"""(?:[^.!?…。！？\n]|[.!?…]+(?![.!?…"'”’)\]]*(?:\s|$))|[.!?…]+["'”’)\]]*[ \t]+(?=[a-zß-öø-ÿ]))*(?:[.!?…]+["'”’)\]]*\s*|[。！？]+\s*|\n\s*|$)""")


def sentences(text: str) -> list[str]:
    """The sentences of a text with the white space that follows them; blank ones are left out."""
    return [m for m in _SENTENCE.findall(text) if m.strip()]


def pack_sentences(text: str | None, max_tokens: int | None = None, overlap: int = 0) -> list[str]:
    """Sentences, or whole sentences packed up to ``max_tokens`` (1.3 a word); a longer one is a chunk by itself.

    With ``overlap`` a chunk begins with the last sentences of the one before that fit so many tokens.
    """
    if not text:
        return []
    parts = sentences(text)
    if max_tokens is None:
        return parts
    chunks: list[str] = []
    current: list[tuple[str, int]] = []
    for s in parts:
        n = ceil(len(s.split()) * TOKENS_A_WORD)
        if current and sum(t for _, t in current) + n > max_tokens:
            chunks.append("".join(x for x, _ in current))
            kept, used = [], 0
            for x, t in reversed(current if overlap > 0 else []):
                if used + t > overlap:
                    break
                kept.append((x, t))
                used += t
            current = kept[::-1]
        current.append((s, n))
    if current:
        chunks.append("".join(x for x, _ in current))
    return chunks


def chunk_by_sentence(df: DataFrame, max_tokens: int | None = None, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_no, chunk) by ``pack_sentences``; null and blank texts have no chunk."""

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([pack_sentences(t, max_tokens, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.select(F.col(key).alias("doc_id"), F.posexplode(pack(F.col(text))).alias("chunk_no", "chunk"))


_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"`{3,}|~{3,}")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s")


def _kind(line: str, item_line: str) -> str:
    """What a line begins: by the trimmed line, but for list items."""
    if not line:
        return "blank"
    if _HEADING.fullmatch(line):
        return "heading"
    if _FENCE.match(line):
        return "code"
    if line.startswith("|"):
        return "table"
    return "list" if _ITEM.match(item_line) else "paragraph"


def markdown_blocks(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of the blocks of a Markdown text; a heading, fence or table may be indented.

    A fence runs to a line of as many or more of its marks, or to the end; blank lines stay within a
    list only before another item. Offsets are in characters.
    """
    lines = text.split("\n")
    at, total = [], 0
    for line in lines:
        at.append(total)
        total += len(line) + 1
    # a trailing line end makes an item of an empty line, as the white space after its mark may be it
    kinds = [_kind(x.strip(), x) for x in lines]
    out: list[tuple[str, str, int]] = []
    i = 0
    while i < len(lines):
        kind, first = kinds[i], i
        i += 1
        if kind == "blank":
            continue
        if kind == "code":
            mark = _FENCE.match(lines[first].strip()).group()
            while i < len(lines):
                closing = lines[i].strip()
                i += 1
                if len(closing) >= len(mark) and set(closing) == {mark[0]}:
                    break
        elif kind == "table":
            while i < len(lines) and lines[i].strip().startswith("|"):
                i += 1
        elif kind == "list":
            while i < len(lines) and (_ITEM.match(lines[i]) or (kinds[i] == "blank" and i + 1 < len(lines) and _ITEM.match(lines[i + 1]))):
                i += 1
        elif kind == "paragraph":
            while i < len(lines) and kinds[i] == "paragraph":
                i += 1
        out.append((kind, "\n".join(lines[first:i]), at[first]))
    return out


def _tokens(text: str) -> int:
    return ceil(len(text) * TOKENS_A_CHAR)


def _stops(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=\.)\s+", text) if s.strip()]


def structure_chunks(text: str | None, max_tokens: int | None = None, overlap: int = 0) -> list[dict]:
    """Chunks {text, headings, offset, type} of a Markdown text.

    ``headings`` are those above the chunk, outermost first, its own included. Only paragraphs are split,
    at full stops, into chunks of ``max_tokens`` (0.25 a character); the offset of a part is where its
    first new sentence is found.
    """
    if not text or not text.strip():
        return []
    above: dict[int, str] = {}
    out: list[dict] = []
    for kind, block, offset in markdown_blocks(text):
        if kind == "heading":
            marks, title = _HEADING.fullmatch(block.strip()).groups()
            above = {level: t for level, t in above.items() if level < len(marks)} | {len(marks): title.strip()}
        heads = [above[level] for level in sorted(above)]
        if kind != "paragraph" or not max_tokens or _tokens(block) <= max_tokens:
            out.append({"text": block, "headings": heads, "offset": offset, "type": kind})
            continue
        current, start, seen = "", offset, 0
        for s in _stops(block):
            where = block.find(s, seen)
            seen = where + len(s)
            if current and _tokens(f"{current} {s}") > max_tokens:
                out.append({"text": current, "headings": heads, "offset": start, "type": kind})
                kept = ""
                for x in reversed(_stops(current) if overlap > 0 else []):
                    longer = f"{x} {kept}" if kept else x
                    if _tokens(longer) > overlap:
                        break
                    kept = longer
                current, start = kept, offset + where - (len(kept) + 1 if kept else 0)
            current = f"{current} {s}" if current else s
        if current.strip():
            out.append({"text": current, "headings": heads, "offset": start, "type": kind})
    return out


#: Texts and characters that a worker splits before it hands their chunks on, about.
SLICE_ROWS, SLICE_CHARS = 64, 1 << 20


def chunk_by_structure(df: DataFrame, max_tokens: int | None = None, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_no, chunk, headings, offset, type) by ``structure_chunks``; null and blank texts have no chunk.

    Texts are split a few at a time, so that a worker holds their chunks alone beside the batch that it was given.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = pa.schema([("chunk_no", pa.int32()), ("chunk", pa.string()), ("headings", pa.list_(pa.string())), ("offset", pa.int32()), ("type", pa.string())])

    def split(batches):
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(b):
                within = int(np.searchsorted(np.cumsum(sizes[at : at + SLICE_ROWS]), SLICE_CHARS, "right"))
                own = b.slice(at, max(1, within))
                at += len(own)
                found = [structure_chunks(t.as_py(), max_tokens, overlap) for t in own.column(1)]
                row = np.repeat(np.arange(len(own)), [len(x) for x in found])
                chunks = [{"chunk_no": n, "chunk": c["text"], "headings": c["headings"], "offset": c["offset"], "type": c["type"]} for x in found for n, c in enumerate(x)]
                if chunks:
                    part = pa.RecordBatch.from_pylist(chunks, kind)
                    yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), *part.columns], names=["doc_id", *kind.names])

    return rows.mapInArrow(split, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk_no int, chunk string, headings array<string>, offset int, type string")
