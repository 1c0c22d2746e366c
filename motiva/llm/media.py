"""Interleaved sequences of text and media from HTML pages.

Parsing a page gives, in order of the page, structs of text and of media references: images, video, audio, embedded objects
and frames, each with its caption (figcaption, else alt, title or aria-label). A reference has a digest: SHA-256 of its
bytes where the page carries them in a data: URI, and of its absolute URL elsewhere. Payloads are resolved by joining
digests: with what pages carry themselves, and with a store of payloads by digest. The join carries references only, each
digest of a page once; it touches neither texts nor positions, so these stay aligned.

Pages that may have references, by their tags, are parsed for these first; what they resolve to is joined to the pages by a
hash of their content, and the pages are parsed again and filled in. That is cheaper than to write and shuffle what the first
parse gives. Pages without such tags are parsed once, where they are.

Defined cases: a null or empty html gives an empty sequence; broken markup is read as browsers would at least as far as text
goes; script, style, template and noscript are skipped, as are navigation and footers if asked; a head
without an end tag ends where what may not stand in it begins; a caption whose figure has no reference is text; a reference without an
address is no reference; a data: URI that can't be decoded has the digest of its text and no payload; a null url leaves
addresses relative; equal digests resolve alike, and of a store's rows that share a digest that with the least payload
counts; pages are parsed whole, however long; repeated rows have a sequence each; a null page_id stays null; other columns are ignored; an empty table gives no
row.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SKIP = frozenset(("script", "style", "template", "noscript", "head", "svg", "math"))
#: What may stand in a head; any other tag, and text outside these, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
FRAME = frozenset(("nav", "footer", "aside"))
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "", "embed": "object", "object": "object", "iframe": "frame", "image": "image"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SEGMENT = "position int, kind string, text string, tag string, url string, digest string, caption string"
KIND = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "tag", "url", "digest", "caption"))]))


def data_uri(uri: str) -> tuple[str, bytes] | None:
    """(media type, bytes) of a data: URI."""
    head, comma, body = uri[5:].partition(",")
    if not comma:
        return None
    raw = unquote_to_bytes(body)
    if head.lower().endswith(";base64"):
        try:
            raw = base64.b64decode(b"".join(raw.split()), validate=True)
        except (binascii.Error, ValueError):
            return None
    return head.split(";")[0].lower() or "text/plain", raw


class Sequence(HTMLParser):
    """Collects ``out``, the segments of a page, and ``inline``, (digest, media type, bytes) of what it carries."""

    def __init__(self, url: str | None, skip: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.skip = url, skip
        self.out: list[dict] = []
        self.inline: list[tuple[str, str, bytes]] = []
        self.text: list[str] = []
        self.closed: list[str] = []
        self.figures: list[tuple[int, list[str], list[int]]] = []  # first segment, words of the caption, segments before its parts
        self.captions = 0
        self.holder = ""

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "tag": None, "url": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.closed == ["head"] and tag not in HEAD or self.closed == ["head", "noscript"] and tag == "body":
            self.closed = []
        if self.closed:
            if tag in self.closed or tag in self.skip or tag == "title" and self.closed == ["head"]:
                if tag not in VOID:
                    self.closed.append(tag)
            return
        if tag in self.skip:
            self.flush()
            self.closed.append(tag)
            return
        if tag in BLOCK or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.out), [], []))
        elif tag == "figcaption":
            self.captions += 1
            if self.figures:
                self.figures[-1][2].append(len(self.out))
        if tag in MEDIA:
            if tag in ("video", "audio"):
                self.holder = tag
            a = dict(reversed(attrs))
            address = next((x.strip() for k in ("src", "data-src", "data", "href", "poster") if (x := a.get(k)) and x.strip()), "")
            if not address and a.get("srcset"):
                address = a["srcset"].split(",")[0].split()[0] if a["srcset"].split(",")[0].split() else ""
            if address:
                self.media(tag, address, next((" ".join(x.split()) for k in ("alt", "title", "aria-label") if (x := a.get(k)) and x.strip()), None))

    def media(self, tag: str, address: str, caption: str | None) -> None:
        kind = MEDIA[tag] or self.holder or "image"
        if address[:5].lower() == "data:":
            found = data_uri(address)
            digest = hashlib.sha256(found[1] if found else address.encode("utf-8", "replace")).hexdigest()
            if found:
                self.inline.append((digest, *found))
            address = address[:5] + (found[0] if found else "")
        else:
            try:
                address = urljoin(self.url or "", address)
            except ValueError:
                pass
            digest = hashlib.sha256(address.encode("utf-8", "replace")).hexdigest()
        self.out.append({"kind": kind, "text": None, "tag": tag, "url": address, "digest": digest, "caption": caption})

    def handle_endtag(self, tag: str) -> None:
        if self.closed == ["head"] and tag in ("body", "html", "br"):
            self.closed = []
        if self.closed:
            if tag in self.closed:
                while self.closed.pop() != tag:
                    pass
            return
        if tag in BLOCK:
            self.flush()
        if tag == self.holder:
            self.holder = ""
        if tag == "figcaption" and self.captions:
            self.captions -= 1
        elif tag == "figure" and self.figures:
            self.figure()

    def figure(self) -> None:
        first, words, at = self.figures.pop()
        caption = " ".join("".join(words).split())
        if caption:
            held = [s for s in self.out[first:] if s["kind"] != "text"]
            for s in held:
                s["caption"] = caption
            if not held:
                self.out.insert(at[0] if at else first, {"kind": "text", "text": caption, "tag": None, "url": None, "digest": None, "caption": None})

    def handle_data(self, data: str) -> None:
        if self.closed == ["head"] and data.strip():
            self.closed = []
        if self.closed:
            return
        if self.captions and self.figures:
            self.figures[-1][1].append(data)
        else:
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self.flush()
        while self.figures:
            self.figure()


def sequence(html: str | None, url: str | None, skip: frozenset[str] = SKIP) -> tuple[list[dict], list[tuple[str, str, bytes]]]:
    """(segments in order, with positions from 0; what the page carries itself)."""
    parser = Sequence(url, skip)
    parser.feed(html or "")
    parser.finish()
    return [{"position": k, **s} for k, s in enumerate(parser.out)], parser.inline


REFERENCE = "key string, digest string, held boolean, mime string, payload binary"
RESULT = f"page_id long, url string, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')},mime:string,payload:binary>>, n_media int, n_resolved int"
FULL = pa.list_(pa.struct([*KIND.value_type, ("mime", pa.string()), ("payload", pa.binary())]))
BATCH_BYTES = 8 << 20


def _references(skip: frozenset[str]):
    """Rows (key, url, html): each digest that a page refers to, once, and each payload that the pages of a batch carry, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "digest", "held", "mime", "payload"], (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.binary())
        for batch in batches:
            seen: set[tuple[str, str, bytes]] = set()
            rows, size = [], 0
            for key, url, html in zip(batch.column(0), batch.column(1), batch.column(2)):
                found, inline = sequence(html.as_py(), url.as_py(), skip)
                rows += [(key.as_py(), d, False, None, None) for d in {s["digest"] for s in found if s["kind"] != "text"}]
                for x in inline:
                    if x not in seen:
                        seen.add(x)
                        rows.append((None, x[0], True, *x[1:]))
                        size += len(x[2])
                if size > BATCH_BYTES or len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _fill(skip: frozenset[str]):
    """Rows (page_id, url, html, got) with got: (digest, mime, payload) of what the page's references resolve to, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rows, size = 0, [], 0
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py()
                found, _ = sequence(html, batch.column(1)[i].as_py(), skip)
                got = {g["digest"]: g for g in batch.column(3)[i].as_py() or ()}
                media = [s for s in found if s["kind"] != "text"]
                for s in media:
                    if (g := got.get(s["digest"])) is not None:
                        s["mime"], s["payload"] = g["mime"], g["payload"]
                        size += len(g["payload"] or b"")
                rows.append((found, len(media), sum(s["digest"] in got for s in media)))
                size += len(html or "")
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    s, n, r = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), batch.column(1).slice(first, len(rows)), pa.array(s, FULL), pa.array(n, pa.int32()), pa.array(r, pa.int32())], names=["page_id", "url", "segments", "n_media", "n_resolved"])
                    first, rows, size = i + 1, [], 0

    return run


TAGS = "(?i)<(" + "|".join(MEDIA) + ")[^a-z]"


def media_sequences(pages: DataFrame, store: DataFrame | None = None, skip_frame: bool = False) -> DataFrame:
    """(page_id, url, segments, n_media, n_resolved): segments have position, kind, text, tag, url, digest, caption, mime and
    payload. ``store``: (digest, mime, payload). ``skip_frame`` leaves navigation, asides and footers out."""
    skip = SKIP | FRAME if skip_frame else SKIP
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    some = F.coalesce(F.col("html").rlike(TAGS), F.lit(False))
    # Equal pages have equal references, so their key may be the same.
    keyed = source.where(some).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("url"), F.lit("\0")), F.lit("\0"), F.col("html")), 256))
    refs = cut(keyed.select("key", "url", "html").mapInArrow(_references(skip), REFERENCE))
    held = refs.where("held").select("digest", "mime", "payload")
    if store is not None:
        held = held.unionByName(store.where("digest is not null").select("digest", F.col("mime").cast("string").alias("mime"), "payload"))
    asked = refs.where("not held").select("key", "digest").distinct()
    payloads = held.join(asked.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("payload", "mime")).alias("p")).select("digest", "p.mime", "p.payload")
    resolved = asked.join(payloads, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "mime", "payload")).alias("got"))
    none = F.lit(None).cast(resolved.schema["got"].dataType)
    joined = keyed.join(resolved, "key", "left").select("page_id", "url", "html", "got")
    return joined.unionByName(source.where(~some).withColumn("got", none)).mapInArrow(_fill(skip), RESULT)
