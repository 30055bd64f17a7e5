"""Markdown documents as units, sections and passages, and the front matter that says what they are."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import ship
from .passages import ALONE, ATX, CLAUSE, HARD_TOKENS, NUMBERED, TARGET_TOKENS

#: What the first line of a unit says it is.
KINDS = (("code", r"^(?:```|~~~)"), ("quote", r"^>"), ("list", r"^(?:[-*+]|\d+[.)])[ \t]+"), ("table", r"^\|.*\|[ \t]*$"), ("horizontal_rule", r"^---[ \t]*$"))
#: The keys of front matter that mean the same, the first one set wins.
ALIASES = {
    "document_type": ("document_type", "type"),
    "collection_id": ("collection_id", "book_id", "series_id", "collection", "book", "series"),
    "collection_title": ("collection_title", "book_title", "series_title", "collection", "book", "series"),
    "jurisdiction": ("jurisdiction",),
    "governing_law": ("governing_law", "governinglaw"),
    "publication_date": ("publication_date", "published", "date"),
    "valid_from": ("valid_from", "effective_date"),
    "valid_to": ("valid_to", "expiry_date"),
}
DATES = ("publication_date", "valid_from", "valid_to")
UNITS = "ordinal int, section int, type string, level int, heading string, path array<string>, text string, start_line long, end_line long, start_byte long, end_byte long"
#: Bytes that a unit, or a line without an end, may have before it is cut: what is held of a document at once, but for its passage.
BUFFER = 8 << 20
SETEXT = r"^([^\r\n]+)\r?\n(=+|-+)[ \t]*$"
FRONT = StructType([*(StructField(k, StringType()) for k in ALIASES), StructField("parties", ArrayType(StringType()))])


def heading(line: str) -> tuple[int, str] | None:
    """The level and text of a line that is a heading: # lines, clauses and numbered lines."""
    bare = line.strip()
    first = bare[:1]
    if first == "#":
        m = re.match(ATX, line)
        return (len(line) - len(line.lstrip("#")), m[1].strip()) if m else None
    if first.isdigit():
        return (min(6, bare.count(".") + 2), bare) if re.match(NUMBERED, bare) else None
    return (2, bare) if first.lower() in "acsr§" and first and re.match(CLAUSE, bare) else None


def underlined(text: str) -> tuple[int, str] | None:
    """The level and text of a unit that is one line and a line of = or - below it."""
    m = re.match(SETEXT, text.rstrip())
    return (1 if m[2][0] == "=" else 2, m[1].strip()) if m else None


@dataclass
class Unit:
    ordinal: int
    section: int
    type: str
    level: int | None
    heading: str | None
    path: tuple[str, ...]
    raw: bytes
    start_line: int
    end_line: int
    start_byte: int

    def row(self) -> tuple:
        return (
            self.ordinal, self.section, self.type, self.level, self.heading, self.path, self.raw.decode("utf-8", "surrogatepass"), self.start_line, self.end_line, self.start_byte,
            self.start_byte + len(self.raw),
        )


class Parser:
    """A document in pieces of bytes, cut anywhere, to its units: runs of lines up to a blank one, whole fenced blocks and
    front matter, headings alone. It holds one unit and an unfinished line, both bounded by buffer; the units are the same
    for every size of the pieces. What it carries between them: the mode (fence or front matter), the section and the path."""

    def __init__(self, buffer: int = BUFFER):
        self.buffer = buffer
        self.tail, self.held, self.size = b"", [], 0
        self.mode: str | None = None
        self.section = self.ordinal = self.at = 0
        self.line = self.first = 1
        self.path: tuple[str, ...] = ()

    def feed(self, data: bytes) -> Iterator[Unit]:
        pieces = (self.tail + data).split(b"\n")
        self.tail = pieces.pop()
        for raw in pieces:
            yield from self._long(raw + b"\n")
        while len(self.tail) > self.buffer + 4:
            part = self._cut(self.tail)
            self.tail = self.tail[len(part) :]
            yield from self._line(part, False)

    def close(self) -> Iterator[Unit]:
        if self.tail:
            yield from self._long(self.tail)
            self.tail = b""
        if self.held:
            self.line -= 1  # the last line has been counted
            yield self._unit("code" if self.mode in ("```", "~~~") else self.mode or self._kind())

    def _cut(self, raw: bytes) -> bytes:
        """The first buffer bytes, or a few less, so that no character is cut."""
        end = self.buffer
        while end > 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        return raw[:end]

    def _long(self, raw: bytes) -> Iterator[Unit]:
        while len(raw) > self.buffer + 4:
            part = self._cut(raw)
            raw = raw[len(part) :]
            yield from self._line(part, False)
        yield from self._line(raw, True)

    def _kind(self) -> str:
        top = self.held[0].decode("utf-8", "surrogatepass").strip()
        return next((k for k, p in KINDS if re.match(p, top)), "paragraph")

    def _unit(self, kind: str, found: tuple[int, str] | None = None) -> Unit:
        raw = self.held[0] if len(self.held) == 1 else b"".join(self.held)
        if found is None and kind != "front_matter" and raw.count(b"\n") < 8:
            found = underlined(raw.decode("utf-8", "surrogatepass"))
        if found:
            self.section, self.path = self.section + 1, (*self.path[: found[0] - 1], found[1])
        unit = Unit(self.ordinal, self.section, kind, *(found or (None, None)), self.path, raw, self.first, self.line, self.at)
        self.held, self.size, self.ordinal, self.at = [], 0, self.ordinal + 1, self.at + len(raw)
        return unit

    def _line(self, raw: bytes, ends: bool) -> Iterator[Unit]:
        text = raw.decode("utf-8", "surrogatepass").rstrip("\r\n")
        bare = text.strip()
        if self.line == 1 and bare == "---" and not self.held:
            self.mode = "front_matter"
        if self.mode is None and (found := heading(text)):
            if self.held:
                here, self.line = self.line, self.line - 1
                yield self._unit(self._kind())
                self.line = here
            self.first, self.held = self.line, [raw]
            yield self._unit("heading", found)
        else:
            if not self.held:
                self.first = self.line
            self.held.append(raw)
            self.size += len(raw)
            full = self.size >= self.buffer
            if self.mode == "front_matter":
                if self.line > 1 and bare == "---":
                    yield self._unit("front_matter")
                    self.mode = None
            elif self.mode:
                if bare.startswith(self.mode):
                    yield self._unit("code")
                    self.mode = None
                elif full:
                    yield self._unit("code")
            elif bare[:3] in ("```", "~~~"):
                self.mode = bare[:3]
            elif not bare or full:
                yield self._unit(self._kind())
        self.line += ends


def cut(text: bytes) -> Iterator[Unit]:
    """The units of a document at hand."""
    parser = Parser()
    yield from parser.feed(text)
    yield from parser.close()


def _columns(rows: list[tuple], spec: str) -> tuple[list[pa.Array], list[str]]:
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    names, kinds = zip(*(c.split() for c in spec.split(", ")))
    return [pa.array(c, arrow[k]) for c, k in zip(zip(*rows), kinds)], list(names)


def _emitted(made: Callable[[Iterator[bytes]], Iterator[tuple]], spec: str) -> Callable:
    """Over batches of (id, data) in order of documents, and of the pieces of each: the rows that made gives of a document's
    pieces, with its id. A document's pieces may lie in several batches; none but the one at hand is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((batch.column(0).slice(k, 1), batch.column(1)[k].as_py()) for batch in batches for k in range(batch.num_rows))
        ready = next(pieces, None)
        while ready is not None:
            name = ready[0]

            def own() -> Iterator[bytes]:
                nonlocal ready
                while ready is not None and ready[0].equals(name):
                    yield ready[1]
                    ready = next(pieces, None)

            held = made(own())
            while rows := list(islice(held, 4096)):
                columns, names = _columns(rows, spec)
                yield pa.record_batch([pa.concat_arrays([name] * len(rows)) if len(rows) < 64 else name.take(pa.array(np.zeros(len(rows), np.int64))), *columns], names=["id", *names])

    return run


def _unit_rows(pieces: Iterator[bytes]) -> Iterator[tuple]:
    parser = Parser()
    for piece in pieces:
        yield from (u.row() for u in parser.feed(piece))
    yield from (u.row() for u in parser.close())


def _whole(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """id and data of every row, and a number that keeps rows of one id apart."""
    return docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id")).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))


def _each(docs: DataFrame, made: Callable, spec: str, text: str, id_column: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    rows = _whole(docs, text, id_column).mapInArrow(_emitted(made, spec), f"id struct<row: long, id: {kind}>, {spec}")
    return rows.select(F.col("id.id").alias("id"), *[c.split()[0] for c in spec.split(", ")])


def units(docs: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """The units of every document with their section, heading, path, lines and bytes: each range gives back its text.

    A document is cut where its row is, so nothing is shuffled. Null and empty texts have no units. A line, or a block
    without a blank line, of over BUFFER bytes is cut there.
    """
    return _each(docs, _unit_rows, UNITS, text, id_column)


def pieces(docs: DataFrame, size: int, text: str = "text", id_column: str = "id") -> DataFrame:
    """(id, seq, data): documents as byte pieces of a size, cut anywhere."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")), lambda i: F.substring(data, (i * size + 1).cast("int"), F.lit(size)))
    return docs.select(F.col(id_column).alias("id"), F.posexplode(cuts).alias("seq", "data"))


def _of_pieces(rows: DataFrame, made: Callable, spec: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.where("id is not null").select("id", "seq", "data").repartition("id").sortWithinPartitions("id", "seq").select("id", "data")
    return dealt.mapInArrow(_emitted(made, spec), f"id {kind}, {spec}")


def units_of_pieces(rows: DataFrame) -> DataFrame:
    """units() of documents that lie in pieces (id, seq, data), which come to one task in order and pass through it: a
    document of any size is never held whole. Pieces without an id are left out; seq says their order and must be unique."""
    return _of_pieces(rows, _unit_rows, UNITS)


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1].strip() if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def properties(text: str) -> dict:
    """The known properties of a front matter block: scalars, inline lists and dash lists, keys under any of their names."""
    scalars, lists, active = {}, {}, None
    for line in re.split(r"\r?\n", text.rstrip("\r\n"))[1:-1]:
        if (item := re.match(r"^[ \t]*-[ \t]+(.+)$", line)) and active:
            lists.setdefault(active, []).append(_unquoted(item[1]))
        elif found := re.match(r"^[ \t]*([A-Za-z][\w -]{0,63})[ \t]*:[ \t]*(.*)$", line):
            key, value = re.sub(r"[ _-]+", "_", found[1].strip().lower()), found[2].strip()
            active = None if value else key
            if value.startswith("[") and value.endswith("]"):
                lists[key] = [v for v in map(_unquoted, value[1:-1].split(",")) if v]
            elif value:
                scalars[key] = _unquoted(value)
    out = {name: next((scalars[k] for k in keys if k in scalars), None) for name, keys in ALIASES.items()}
    for name in DATES:
        out[name] = out[name] if _is_date(out[name]) else None
    split = [p.strip() for p in re.split("[;,]", scalars.get("parties", "")) if p.strip()]
    return out | {"parties": lists.get("parties") or lists.get("party") or split}


def _is_date(value: str | None) -> bool:
    if not re.match(r"^\d{4}-\d{2}-\d{2}(?:[T ][0-9:.+\-Z]+)?$", value or ""):
        return False
    try:
        dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


@F.pandas_udf(FRONT)
def _front(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([properties(b) for b in blocks], columns=[*ALIASES, "parties"])


def front_matter(text: Column) -> Column:
    """What a document says of itself between --- lines at its top; null where it has no such block. Only the block goes through Python."""
    block = F.regexp_extract(text, r"(?s)^(---[ \t]*\r?\n.*?\r?\n---[ \t]*)(?:\r?\n|\z)", 1)
    return F.when(block != "", _front(block))


SECTIONS = "section int, level int, heading string, path array<string>, first_line long, last_line long, start_byte long, end_byte long"


def _section_rows(data: Iterator[bytes]) -> Iterator[tuple]:
    parser, now = Parser(), None

    def every() -> Iterator[Unit]:
        for piece in data:
            yield from parser.feed(piece)
        yield from parser.close()

    for u in every():
        end = u.start_byte + len(u.raw)
        if now is None or u.section != now[0]:
            if now is not None:
                yield tuple(now)
            path = u.path if u.level else None
            now = [u.section, u.level, u.heading, path, u.start_line, u.end_line, u.start_byte, end]
        else:
            now[5], now[7] = u.end_line, end
    if now is not None:
        yield tuple(now)


def sections(docs: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """(id, section, level, heading, path, first_line, last_line, start_byte, end_byte) of every document: a section begins at
    each heading, of whatever kind; what stands before the first one is section 0 without a heading. One pass, no shuffle."""
    return _each(docs, _section_rows, SECTIONS, text, id_column)


PASSAGES = "section int, passage int, path array<string>, type string, text string, lexical_text string, tokens int, start_line long, end_line long, start_byte long, end_byte long"


def _split(unit: Unit, most: int) -> Iterator[tuple[bytes, str, int]]:
    """A unit in parts of at most so many bytes, no character cut: the part, what its lexical text has in front, where it starts."""
    raw = unit.raw
    if len(raw) <= most:
        yield raw, "", 0
        return
    header = ""
    if unit.type == "table":
        header = "\n".join(re.split(r"\r?\n", raw.decode("utf-8", "surrogatepass"))[:2]).strip()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while at + 1 < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end], header + "\n" if header and at else "", at
        at = end


def _passage_rows(target: int, hard: int) -> Callable[[Iterator[bytes]], Iterator[tuple]]:
    """The passages of a document, packed as its units come: what is held is the passage at hand."""
    most = max(1024, hard * 4)

    def made(data: Iterator[bytes]) -> Iterator[tuple]:
        parser = Parser()
        held: list[tuple[bytes, str, int, int, int, str]] = []  # bytes, prefix, start byte, lines, type
        tokens = number = 0
        section, path = -1, ()

        def flush() -> Iterator[tuple]:
            nonlocal held, tokens, number
            if held:
                raw = b"".join(h[0] for h in held)
                text = raw.decode("utf-8", "surrogatepass")
                start = held[0][2]
                yield section, number, path, held[0][5], text, "".join(h[1] for h in held) + text, max(1, -(-len(text) // 4)), held[0][3], held[-1][4], start, start + len(raw)
                held, tokens, number = [], 0, number + 1

        def every() -> Iterator[Unit]:
            for piece in data:
                yield from parser.feed(piece)
            yield from parser.close()

        for unit in every():
            if unit.type == "front_matter":
                continue
            if unit.section != section:
                yield from flush()
                section, path, number = unit.section, unit.path, 0
            if held and held[-1][5] != unit.type and (held[-1][5] in ALONE or unit.type in ALONE):
                yield from flush()
            line = unit.start_line
            for raw, prefix, at in _split(unit, most):
                n = max(1, -(-len(raw.decode("utf-8", "surrogatepass")) // 4))
                if held and tokens + n > target:
                    yield from flush()
                ends = line + raw.count(b"\n")
                held.append((raw, prefix, unit.start_byte + at, line, max(line, ends - raw.endswith(b"\n")), unit.type))
                line, tokens = ends, tokens + n
                if tokens >= hard:
                    yield from flush()
        yield from flush()

    return made


def passages(docs: DataFrame, text: str = "text", id_column: str = "id", target: int = TARGET_TOKENS, hard: int = HARD_TOKENS) -> DataFrame:
    """(id, section, passage, path, type, text, lexical_text, tokens, lines, bytes): a section's units packed up to the target.

    Passages are packed in the pass that cuts the document, so nothing is shuffled. Code, tables and other text do not share
    a passage; a unit of over hard tokens (4 bytes each) is split, and the later parts of a table repeat its header in
    their lexical text. Front matter is no passage.
    """
    return _each(docs, _passage_rows(target, hard), PASSAGES, text, id_column)


def passages_of_pieces(rows: DataFrame, target: int = TARGET_TOKENS, hard: int = HARD_TOKENS) -> DataFrame:
    """passages() of documents that lie in pieces (id, seq, data), as units_of_pieces() reads them."""
    return _of_pieces(rows, _passage_rows(target, hard), PASSAGES)


ship(__name__)
