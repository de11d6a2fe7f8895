"""Word documents as tables: text units with their segments and images in, rewritten documents out.

A document is a zip of XML parts. Parsing and rewriting run per document in Arrow batches; everything between is native.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import host_of, is_public_host

# Names of the public file format. Fixed values.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BODY = "word/document.xml"
SEGMENT = "struct<kind:string,start:int,end:int,text:string,node_path:string>"
UNITS = f"doc_id bigint, path string, unit_id int, part_name string, container_id string, context array<string>, text string, segments array<{SEGMENT}>, links array<string>"
IMAGES = "doc_id bigint, path string, image_id string, content binary"
#: Document properties that name people or say what they wrote.
PROPERTIES = ("creator", "lastModifiedBy", "description", "keywords", "subject", "category")


class Unreadable(ValueError):
    """Not a Word document."""


def read_binary(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """doc_id, path and content of all documents below a path, or of one file."""
    name = path.lower()
    if "." in Path(path).name and not name.endswith(".docx"):
        raise ValueError(f"{path}: a .docx file is asked for")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    reader = spark.read.format("binaryFile")
    if not name.endswith(".docx"):
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        z.getinfo(BODY)
    except (zipfile.BadZipFile, KeyError) as e:
        raise Unreadable(str(e)) from e
    return z


def parts(z: zipfile.ZipFile) -> list[str]:
    """The body, then each header and footer that its sections refer to, once, in the order of their references."""
    out = [BODY]
    try:
        rels = {r.get("Id"): "word/" + r.get("Target", "").lstrip("/").removeprefix("word/") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    except KeyError:
        return out
    for ref in ET.fromstring(z.read(BODY)).iter():
        if ref.tag in (W + "headerReference", W + "footerReference") and (name := rels.get(ref.get(R + "id"))) and name in z.namelist() and name not in out:
            out.append(name)
    return out


_SKIP = {W + x for x in ("pPr", "rPr", "del", "delText", "moveFrom", "p")}


def segments(p: ET.Element) -> list[tuple[str, ET.Element]]:
    """(kind, element) of a paragraph's own runs: text, tab, break and field instructions, in order."""
    out: list[tuple[str, ET.Element]] = []
    for x in p:
        if x.tag in _SKIP:
            continue
        kind = {W + "t": "text", W + "tab": "tab", W + "br": "break", W + "cr": "break", W + "instrText": "instr"}.get(x.tag)
        if kind:
            out.append((kind, x))
        else:
            out += segments(x)
    return out


def text_of(kind: str, node: ET.Element) -> str:
    return {"tab": "\t", "break": "\n", "instr": ""}.get(kind, node.text or "")


def paragraphs(root: ET.Element) -> Iterator[tuple[ET.Element, str, tuple[str, ...]]]:
    """Paragraph, container and table context of all paragraphs, in reading order.

    The container is the enclosing table cell, else the parent. The context of a cell is up to six words of two letters
    or more of its column's first cell; none in the first row.
    """
    numbers: dict[ET.Element, int] = {x: k for k, x in enumerate(root.iter())}

    def walk(node: ET.Element, cell: ET.Element | None, context: tuple[str, ...]):
        for x in node:
            if x.tag == W + "p":
                yield x, f"{numbers[cell if cell is not None else node]}", context
                yield from walk(x, cell, context)
            elif x.tag == W + "tbl":
                heads: list[str] = []
                for i, row in enumerate(x.findall(W + "tr")):
                    for j, tc in enumerate(row.findall(W + "tc")):
                        if i == 0:
                            heads.append(" ".join("".join(text_of(*s) for s in segments(p)) for p in tc.iter(W + "p")))
                        words = tuple(re.findall(r"[^\W\d_]{2,}", heads[j]))[:6] if i and j < len(heads) else ()
                        yield from walk(tc, tc, words)
            else:
                yield from walk(x, cell, context)

    yield from walk(root, None, ())


def units(content: bytes) -> Iterator[dict]:
    """Rows of all paragraphs that hold text; those without get no number."""
    z = _open(content)
    n = 0
    for part in parts(z):
        for p, container, context in paragraphs(ET.fromstring(z.read(part))):
            own, at = [], 0
            for k, (kind, node) in enumerate(segments(p)):
                text = text_of(kind, node)
                own.append({"kind": kind, "start": at, "end": at + len(text), "text": text if kind != "instr" else node.text or "", "node_path": f"{part}#{k}"})
                at += len(text)
            whole = "".join(s["text"] for s in own if s["kind"] != "instr")
            fields = "".join(s["text"] for s in own if s["kind"] == "instr")
            if whole.strip():
                yield {"unit_id": n, "part_name": part, "container_id": f"{part}#{container}", "context": list(context), "text": whole, "segments": own, "links": re.findall(r'"([^"]+)"', fields)}
                n += 1


def text_units(docs: DataFrame) -> DataFrame:
    """A row for each text unit of documents (doc_id, path, content); unreadable documents end the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, path, content in zip(batch.doc_id, batch.path, batch.content, strict=True):
                found = [{"doc_id": doc_id, "path": path} | u for u in units(content)]
                if found:
                    yield pd.DataFrame(found)

    return docs.mapInPandas(run, UNITS)


CONTENT_TYPES = "[Content_Types].xml"


def image_parts(z: zipfile.ZipFile) -> list[str]:
    """The parts whose content type is an image's, by their own entry or their name's ending; and what is in the folder
    for media without any type."""
    names = sorted(set(z.namelist()))
    root = ET.fromstring(z.read(CONTENT_TYPES)) if CONTENT_TYPES in names else ET.Element("Types")
    of_part = {x.get("PartName", "").lstrip("/"): x.get("ContentType", "") for x in root if x.tag.endswith("Override")}
    of_ending = {x.get("Extension", "").lower(): x.get("ContentType", "") for x in root if x.tag.endswith("Default")}
    kind = lambda n: of_part.get(n) or of_ending.get(n.rpartition(".")[2].lower(), "image/" if n.startswith("word/media/") else "")
    return [n for n in names if kind(n).startswith("image/")]


def images(docs: DataFrame) -> DataFrame:
    """A row for each image part of the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, p, f"{d}/{n}", z.read(n)) for d, p, c in zip(batch.doc_id, batch.path, batch.content, strict=True) for z in [_open(c)] for n in image_parts(z)]
            yield pd.DataFrame(out, columns=["doc_id", "path", "image_id", "content"])

    return docs.mapInPandas(run, IMAGES)


# ---- writing


def apply(nodes: list[tuple[str, ET.Element]], replaced: list[tuple[int, int, str]]) -> set[ET.Element]:
    """Puts fakes, last range first, into the first text node that a range touches; the rest of the range is deleted.
    A range without a text node prefixes the next one. Returns tabs and breaks to remove."""
    at, places = 0, []
    for kind, node in nodes:
        size = len(text_of(kind, node))
        places.append((kind, node, at, at + size))
        at += size
    gone: set[ET.Element] = set()
    for start, end, fake in sorted(replaced, reverse=True):
        put = False
        for kind, node, a, b in places:
            if kind == "text" and a < end and start < b:
                text = node.text or ""
                # Ranges are applied from the last on, so what is before and in this one still has its places.
                head, tail = text[: max(0, start - a)], text[max(0, min(end, b) - a) :]
                node.text = head + ("" if put else fake) + tail
                put = True
            elif kind in ("tab", "break") and start <= a and b <= end and a < b:
                gone.add(node)
        if not put and fake:
            nxt = next((n for k, n, a, b in places if k == "text" and a >= end), None)
            if nxt is not None:
                nxt.text = fake + (nxt.text or "")
    for kind, node, _, _ in places:
        if kind == "text" and node.text != (node.text or "").strip():
            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return gone


LINK = re.compile(r"(?i)(?:mailto:)?[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:https?://|www\.)[^\s\"<>]+")


def rewritten_link(text: str, hosts: dict[str, str], mails: dict[str, str]) -> str:
    """Private mail addresses and sites of a link by their fakes; public ones as they are."""

    def one(m: re.Match) -> str:
        found = m[0]
        if "@" in found:
            lead, mail = ("mailto:", found[7:]) if found.lower().startswith("mailto:") else ("", found)
            return lead + mails[mail.lower()] if mail.lower() in mails else found
        lead = re.match(r"(?i)(?:https?://)?(?:www\.)?", found)[0]
        host = re.split(r"[/:?#]", found[len(lead) :], maxsplit=1)[0].lower()
        return lead + hosts[host] if host in hosts else found

    return LINK.sub(one, text)


def _serialised(root: ET.Element, source: bytes) -> bytes:
    """With all name spaces that the source declares, whether used or not: some parts name prefixes in attributes."""
    spaces = [ns for _, ns in ET.iterparse(io.BytesIO(source), ["start-ns"])]
    for prefix, uri in spaces:
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    out = ET.tostring(root, encoding="unicode")
    head = out[: out.index(">")]
    missing = "".join(f' xmlns:{p}="{u}"' for p, u in dict(spaces).items() if p and f"xmlns:{p}=" not in head)
    cut = len(head) - head.endswith("/")
    return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + (out[:cut] + missing + out[cut:]).encode()


def rewrite(content: bytes, replaced: dict[int, list[tuple[int, int, str]]], hosts: dict[str, str], mails: dict[str, str], pictures: dict[str, bytes] | None = None) -> bytes:
    """A document with its units' ranges replaced, field codes and outside links rewritten, properties blanked and
    pictures exchanged; all other parts byte for byte."""
    z = _open(content)
    changed: dict[str, bytes] = dict(pictures or {})
    n = 0
    for part in parts(z):
        source = z.read(part)
        root = ET.fromstring(source)
        parent = {c: p for p in root.iter() for c in p}
        for p, _, _ in list(paragraphs(root)):
            nodes = segments(p)
            if "".join(text_of(k, x) for k, x in nodes if k != "instr").strip():
                for x in apply(nodes, replaced.get(n, [])):
                    parent[x].remove(x)
                n += 1
            codes = [x for k, x in nodes if k == "instr"]
            if codes:
                whole = "".join(x.text or "" for x in codes)
                if (new := rewritten_link(whole, hosts, mails)) != whole:
                    codes[0].text = new
                    for x in codes[1:]:
                        x.text = ""
        for x in root.iter(W + "fldSimple"):
            x.set(W + "instr", rewritten_link(x.get(W + "instr", ""), hosts, mails))
        changed[part] = _serialised(root, source)
    for name in z.namelist():
        if name.startswith("word/_rels/") and name.endswith(".rels"):
            source = z.read(name)
            root = ET.fromstring(source)
            for r in root:
                if r.get("TargetMode") == "External" and r.get("Type", "").endswith("/hyperlink"):
                    r.set("Target", rewritten_link(r.get("Target", ""), hosts, mails))
            changed[name] = _serialised(root, source)
        elif name == "docProps/core.xml":
            source = z.read(name)
            root = ET.fromstring(source)
            for x in root:
                if x.tag.rpartition("}")[2] in PROPERTIES:
                    x.text = ""
            changed[name] = _serialised(root, source)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in z.infolist():
            target.writestr(info, changed.get(info.filename, z.read(info.filename)))
    return out.getvalue()


def rewritten(docs: DataFrame, redacted: DataFrame, mails: DataFrame | None = None, hosts: DataFrame | None = None, pictures: DataFrame | None = None) -> DataFrame:
    """doc_id, path and new content. redacted: doc_id, unit_id, replaced; mails and hosts: doc_id, key, fake;
    pictures: doc_id, image_id, content of those that change."""
    units_ = redacted.where(F.size("replaced") > 0).groupBy("doc_id").agg(F.collect_list(F.struct("unit_id", "replaced")).alias("units"))
    out = docs.join(units_, "doc_id", "left")
    for name, df in (("mails", mails), ("hosts", hosts)):
        col = df.groupBy("doc_id").agg(F.collect_list(F.struct("key", "fake")).alias(name)) if df is not None else None
        out = out.join(col, "doc_id", "left") if col is not None else out.withColumn(name, F.array().cast("array<struct<key:string,fake:string>>"))
    if pictures is not None:
        out = out.join(pictures.groupBy("doc_id").agg(F.collect_list(F.struct("image_id", F.col("content").alias("bytes"))).alias("pictures")), "doc_id", "left")
    else:
        out = out.withColumn("pictures", F.array().cast("array<struct<image_id:string,bytes:binary>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: [] if x is None else x
        for b in batches:
            made = []
            for doc_id, path, content, us, ms, hs, ps in zip(b.doc_id, b.path, b.content, b.units, b.mails, b.hosts, b.pictures, strict=True):
                by = {u["unit_id"]: [(r["start"], r["end"], r["fake"]) for r in u["replaced"]] for u in some(us)}
                new = rewrite(content, by, {x["key"]: x["fake"] for x in some(hs)}, {x["key"]: x["fake"] for x in some(ms)}, {x["image_id"].partition("/")[2]: x["bytes"] for x in some(ps)})
                made.append((doc_id, path, new))
            yield pd.DataFrame(made, columns=["doc_id", "path", "content"])

    return out.mapInPandas(run, "doc_id bigint, path string, content binary")


def _plain(path: Column) -> Column:
    """A path without its scheme, however many slashes that has."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def save(docs: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """Writes each document below a folder that the executors reach, at its path below ``root`` (or under its own name);
    returns path and bytes. Two documents of one place end the run before anything is written."""
    below = _plain(F.lit((root or "").rstrip("/") + "/"))
    inside = F.lit(bool(root)) & F.startswith(_plain(F.col("path")), below)
    target = F.when(inside, F.substring(_plain(F.col("path")), F.length(below) + 1, F.length("path"))).otherwise(F.substring_index("path", "/", -1))
    docs = docs.select(target.alias("path"), "content")
    if twice := docs.groupBy("path").count().where("count > 1").take(1):
        raise ValueError(f"{twice[0]['count']} documents would be written to {twice[0]['path']}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for path, content in zip(b.path, b.content, strict=True):
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target + ".part") as f:
                    f.write(content)
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
                store.move(target + ".part", target)
                done.append((target, len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return docs.mapInPandas(run, "path string, bytes long")


def private_links(links: Column) -> Column:
    """Link targets that aren't public."""
    return F.filter(links, lambda x: ~is_public_host(host_of(x)))

