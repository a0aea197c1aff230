"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of text and media-reference structs. References carry the digest of
their payload; a join on the digest resolves them against a media table whose payloads were written once,
losslessly, as 8-bit grey PNG images, and read back. Positions and captions stay with their item.
Payload bytes never go through a shuffle: the join carries what was computed from them.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, map_arrow, stored

#: A payload is padded with PAD to a positive multiple of UNIT: one row of the image.
UNIT = 576
PAD = b"\xff"
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of UNIT samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; ValueError for anything else or a damaged one."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, width = 8, [], 0
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that to_png does not use")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit difference hash over a 9 x 8 grid of means."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x, np.linspace(0, len(x), 72, endpoint=False).astype(np.int64), dtype=np.int64).reshape(8, 9)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return f"{len(x) // UNIT}:{x.mean():.4f}:{x.std():.4f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


class _Figure:
    """An open figure: its media without a caption, its captions (items of their own until it ends), and the text of an open one."""

    def __init__(self) -> None:
        self.media: list[dict] = []
        self.said: list[dict] = []
        self.caption: list[str] | None = None


class _Items(HTMLParser):
    """Text and media references in document order.

    A figure's caption goes to all media of the figure (those of figures within it that have none of their own too), else
    their alt text. Without such media it is a text where it stands. It ends with the figure or the page at the latest.
    """

    SKIP = {"script", "style", "template", "title"}
    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "figure", "figcaption", "table", "ul", "ol", "body", "td", "th", "pre", "blockquote"}
    MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "object": "data"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[_Figure] = []
        self.picture: list[str] | None = None  # what an open picture offers besides its image
        self.shown = False  # its image has come

    def add(self, kind: str, **values: str | None) -> dict:
        self.items.append({"position": 0, "kind": kind, "text": None, "digest": None, "caption": None} | values)
        return self.items[-1]

    def open_caption(self) -> list[str] | None:
        return self.figures[-1].caption if self.figures else None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text=text)

    def end_caption(self) -> None:
        figure = self.figures[-1]
        if figure.caption is not None:
            figure.said[-1]["text"] = " ".join("".join(figure.caption).split())
            figure.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        said = " ".join(x["text"] for x in figure.said if x["text"])
        if said and figure.media:
            for item in figure.media:
                item["caption"] = said
        else:
            for item in figure.said:
                item["kind"] = "text" if item["text"] else "caption"
            if self.figures:
                self.figures[-1].media += figure.media

    def end_page(self) -> list[dict]:
        self.close()
        self.end_picture()
        self.flush()
        while self.figures:
            self.end_figure()
        items = [x for x in self.items if x["kind"] != "caption"]
        for i, item in enumerate(items):
            item["position"] = i
        return items

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCK:
            self.flush()
            if (caption := self.open_caption()) is not None:
                caption.append(" ")
        if tag == "figure":
            self.figures.append(_Figure())
        if tag == "figcaption" and self.figures:
            self.end_caption()
            self.figures[-1].said.append(self.add("caption"))
            self.figures[-1].caption = []
        if tag == "picture":
            self.end_picture()
            self.picture, self.shown = [], False
        if tag in self.MEDIA:
            at = dict(attrs)
            ref = at.get(self.MEDIA[tag]) or ((at.get("srcset") or "").split() or [""])[0].rstrip(",")
            if ref and tag == "source" and self.picture is not None:
                self.picture.append(ref)
            elif ref:
                self.add_media(ref, at.get("alt"))
                self.shown = self.shown or tag == "img"

    def add_media(self, ref: str, caption: str | None) -> None:
        self.flush()
        item = self.add("media", digest=ref.removeprefix(SCHEME), caption=caption)
        if self.figures:
            self.figures[-1].media.append(item)

    def end_picture(self) -> None:
        """A picture is one item: its image, or what it offers first."""
        if self.picture and not self.shown:
            self.add_media(self.picture[0], None)
        self.picture = None

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCK:
            self.flush()
            if (caption := self.open_caption()) is not None:
                caption.append(" ")
        if tag == "picture":
            self.end_picture()
        if tag == "figcaption" and self.figures:
            self.end_caption()
        if tag == "figure" and self.figures:
            self.end_picture()
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            caption = self.open_caption()
            (self.text if caption is None else caption).append(data)


def parse_items(page: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(page or "")
    return parser.end_page()


def html_items(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """Per row ``id_col`` and ``items``, an array of ITEM in document order; empty for a null or empty page.

    Very long pages are parsed whole. Repeated rows and null ids give a row each, an empty table an empty result; other columns are ignored.
    """
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_items(x) for x in batch.column(1).to_pylist()], item)], names=[id_col, "items"])

    part = df.select(F.col(id_col), F.col(html_col).alias("__html"))
    return map_arrow(part, run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, items array<{ITEM}>")


def media_facts(media: DataFrame) -> DataFrame:
    """One row per ``digest`` of a media table (digest, n_bytes, stored): what its stored bytes give when read back."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = from_png(data)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    facts = map_arrow(media.select("digest", "n_bytes", "stored"), run, "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return facts.groupBy("digest").agg(*(F.min(c).alias(c) for c in names[1:]))  # equal digests have equal payloads


def resolve(items: DataFrame, facts: DataFrame, texts: bool = True) -> DataFrame:
    """One row per item in ``items``: its other columns, ``position``, ``kind``, ``text``, ``digest``, ``caption`` and the media's columns.

    Media references without a media row, and text, have nulls there. ``position`` orders a document's items. Only
    references meet the media table: text, which has no digest, is not shuffled. Without ``texts``, references only.
    """
    others = [c for c in items.columns if c != "items"]
    each = items.select(*others, F.explode("items").alias("i")).select(*others, "i.*")
    refs = each.where("kind = 'media'").join(facts, "digest", "left")
    out = refs.unionByName(each.where("kind <> 'media'"), allowMissingColumns=True) if texts else refs
    return out.select(*each.columns, *[c for c in facts.columns if c != "digest"])


def digest_of(data: bytes, payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest() + f"-{len(data)}"


def page_of(text: str) -> str:
    """The lines of a text as paragraphs, and after the first an image of the whole text, its caption on either side."""
    data = text.encode()
    ref = f'<img src="{SCHEME}{digest_of(data, padded(data))}" alt="page image">'
    said = f"<figcaption>{len(data)} bytes</figcaption>"
    first, *rest = [f"<p>{html.escape(line)}</p>" for line in text.split("\n")]
    return f"<article>{first}<figure>{said + ref if len(data) % 2 else ref + said}</figure>{''.join(rest)}</article>"


def document_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``html``, a page per row that shows its text as paragraphs and as an image. A null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_of(t or "") for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "html"])

    part = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return map_arrow(part, run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, html string")


def text_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table of the texts' images: ``digest``, ``n_bytes``, ``stored``. Equal texts of a partition give one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests, sizes, images = [], [], []
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                payload = padded(data)
                digest = digest_of(data, payload)
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    sizes.append(len(data))
                    images.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["digest", "n_bytes", "stored"])

    return map_arrow(df.select(F.col(text_col).alias("__text")), run, "digest string, n_bytes bigint, stored binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload as stored in the media table and resolved through its page's reference, with its place in the page's sequence."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    facts = stored(media_facts(stored(text_media(docs), "media")), "facts")
    items = html_items(document_pages(docs), "doc_id")
    texts = F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: i["text"])
    items = items.select("doc_id", F.size("items").alias("n_items"), F.sha2(F.array_join(texts, "\n"), 256).alias("items_sha256"), F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    found = resolve(items, facts, texts=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "items_sha256")
