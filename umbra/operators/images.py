"""Personal data in images: words from a recogniser's table to lines, boxes, painted pixels and reports.

Recognisers (words, faces, codes) are hooks, since none is part of the library: a hook maps a batch of images to rows.
Geometry is native; the two steps that are loops by nature, grouping words to lines and the rules of identity cards,
run per image in Arrow batches, an image being small.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import host_of
from .docpass import mentions

WORDS = "image_id string, word_id int, text string, `left` int, top int, width int, height int, conf double"
LINES = "image_id string, line_id int, word_id int, text string, `left` int, top int, width int, height int, conf double, at int"
BOXES = "image_id string, entity_type string, l int, t int, r int, b int, source string"
LEAST_CONF, LOOSE, SAME_ROW, SPLIT_AT = 30.0, 4.0, 0.5, 2.5
MAGIC = {"PNG": b"\x89PNG", "JPEG": b"\xff\xd8\xff", "BMP": b"BM", "GIF": b"GIF8", "TIFF": b"II*\x00", "WEBP": b"RIFF"}


def image_format(content: Column) -> Column:
    """Format by the first bytes; null for others, which are skipped and not an error."""
    out = F.lit(None).cast("string")
    for name, lead in MAGIC.items():
        out = F.when(F.substring(content, 1, len(lead)) == F.lit(lead), F.lit(name)).otherwise(out)
    return F.when(F.substring(content, 1, 4) == F.lit(b"MM\x00*"), F.lit("TIFF")).otherwise(out)


def recognised_words(images: DataFrame, hook: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Words of images (image_id, content) by a hook; without one, read a table of words instead."""
    return images.mapInPandas(hook, WORDS)


def languages(asked: str, installed: set[str]) -> str:
    """What a word recogniser is asked to read: 'auto' is English, with Hindi where that is installed."""
    return asked if asked != "auto" else "eng+hin" if "hin" in installed else "eng"


def scale_to(width: int, height: int, long_side: int = 1600) -> int:
    """How many times an image is enlarged before recognition: to about the long side, one to four times."""
    return max(1, min(4, round(long_side / max(width, height, 1))))


def preprocess(pixels: np.ndarray, times: int = 1) -> np.ndarray:
    """Grey, contrast stretched between the 1st and 99th percentile and raised, sharpened, enlarged."""
    grey = pixels[..., :3].astype(float) @ (0.299, 0.587, 0.114) if pixels.ndim == 3 else pixels.astype(float)
    low, high = np.percentile(grey, (1, 99))
    out = np.clip((grey - low) * 255 / max(high - low, 1), 0, 255)
    out = np.clip((out - out.mean()) * 1.8 + out.mean(), 0, 255)
    p = np.pad(out, 1, mode="edge")
    blur = sum(p[i : i + out.shape[0], j : j + out.shape[1]] for i in range(3) for j in range(3)) / 9
    out = np.clip(out + 0.5 * (out - blur), 0, 255)
    return np.kron(out, np.ones((times, times))).astype(np.uint8)


def unscaled(words: DataFrame, times: Column) -> DataFrame:
    """Places in the image as it was; no side under one pixel."""
    small = lambda c, least=None: F.greatest((F.col(c) / times).cast("int"), F.lit(least)) if least else (F.col(c) / times).cast("int")
    return words.withColumns({"left": small("left"), "top": small("top"), "width": small("width", 1), "height": small("height", 1)})


def readable(words: DataFrame) -> DataFrame:
    """Words that were read with some confidence and hold a letter, digit or Devanagari character, without giant ones."""
    rows = words.where(F.col("text").isNotNull() & (F.col("conf") >= LEAST_CONF)).withColumn("text", F.btrim("text")).where(F.col("text").rlike(r"(?U)\w|[ऀ-ॿ]"))
    median = F.median("height").over(Window.partitionBy("image_id"))
    return rows.withColumn("_m", median).where(F.col("height") <= LOOSE * F.col("_m")).drop("_m")


def _rows_of(words: pd.DataFrame) -> list[list[int]]:
    """Indices of words by row: each goes to the row it overlaps most, by half its height or more, else begins one."""
    rows: list[list[int]] = []
    for k in words.sort_values(["top", "left"]).index:
        top, bottom = words.top[k], words.top[k] + words.height[k]
        best, most = None, SAME_ROW
        for row in rows:
            t = float(np.median(words.top[row]))
            b = float(np.median(words.top[row] + words.height[row]))
            shared = (min(bottom, b) - max(top, t)) / max(1, min(bottom - top, b - t))
            if shared >= most:
                best, most = row, shared
        if best is None:
            rows.append([k])
        else:
            best.append(k)
    return rows


def _lines_of(words: pd.DataFrame) -> pd.DataFrame:
    words = words.reset_index(drop=True)
    lines: list[list[int]] = []
    for row in _rows_of(words):
        row = sorted(row, key=lambda k: (words.left[k], words.word_id[k]))
        line = [row[0]]
        for a, b in zip(row, row[1:]):  # noqa: B905
            if words.left[b] - (words.left[a] + words.width[a]) > SPLIT_AT * max(words.height[a], words.height[b]):
                lines.append(line)
                line = []
            line.append(b)
        lines.append(line)
    lines.sort(key=lambda x: (min(words.top[k] for k in x), min(words.left[k] for k in x)))
    out = []
    for n, line in enumerate(lines):
        at = 0
        for k in line:
            out.append((words.image_id[k], n, words.word_id[k], words.text[k], words.left[k], words.top[k], words.width[k], words.height[k], words.conf[k], at))
            at += len(words.text[k]) + 1
    return pd.DataFrame(out, columns=["image_id", "line_id", "word_id", "text", "left", "top", "width", "height", "conf", "at"])


def group_lines(words: DataFrame) -> DataFrame:
    """Words with their line and their place in the line's text (words parted by one blank)."""
    return words.groupBy("image_id").applyInPandas(_lines_of, LINES)


def split_at_gaps(words: DataFrame) -> DataFrame:
    """The second half of grouping alone, natively: words (image_id, row_id, left, width, height) with part, which grows
    where a gap is wider than two and a half times the taller neighbour."""
    w = Window.partitionBy("image_id", "row_id").orderBy("left")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w)
    wide = gap > SPLIT_AT * F.greatest("height", F.lag("height").over(w))
    return words.withColumn("_new", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(w)).drop("_new")


def line_texts(lines: DataFrame) -> DataFrame:
    """image_id, line_id, text, box and median height of each line."""
    words = F.array_sort(F.collect_list(F.struct("at", "text")))
    return lines.groupBy("image_id", "line_id").agg(
        F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("text"), F.median("height").cast("int").alias("median_height"), *union_box_columns()
    )


def union_box_columns() -> list[Column]:
    return [F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b")]


def context_words(lines: DataFrame, most: int = 300) -> DataFrame:
    """image_id, context: the different words of an image in reading order, as cues for its recognisers."""
    rows = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "at", F.lower("text").alias("text")))).alias("w"))
    return rows.select("image_id", F.slice(F.array_distinct(F.transform("w", lambda x: x["text"])), 1, most).alias("context"))


def boxes_of_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans (image_id, line_id, start, end, entity_type, source) as boxes around the words they touch."""
    rows = spans.join(lines, ["image_id", "line_id"]).where((F.col("at") < F.col("end")) & (F.col("start") < F.col("at") + F.length("text")))
    return rows.groupBy("image_id", "line_id", "start", "end", "entity_type", "source").agg(*union_box_columns()).select("image_id", "entity_type", "l", "t", "r", "b", "source")


def text_boxes(lines: DataFrame, detect: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, identity: DataFrame | None = None) -> DataFrame:
    """Boxes of personal data in the lines' texts. detect: units to units with spans. On identity cards recognised names
    count for nothing; known (doc_id: the image, key,
    entity_type) are names from the document that the image is part of."""
    texts = line_texts(lines).join(context_words(lines), "image_id").select(F.col("image_id").alias("doc_id"), F.col("line_id").alias("unit_id"), "text", "context")
    spans = detect(texts).select(F.col("doc_id").alias("image_id"), F.col("unit_id").alias("line_id"), F.explode("spans").alias("s"))
    spans = spans.select("image_id", "line_id", "s.start", "s.end", "s.entity_type", "s.source")
    if identity is not None:
        spans = spans.join(identity.where("is_id").select("image_id").withColumn("_id", F.lit(True)), "image_id", "left").where(F.col("_id").isNull() | (F.col("source") != C.NER)).drop("_id")
    if known is not None:
        spans = spans.unionByName(mentions(texts, known, ["entity_type"]).select(F.col("doc_id").alias("image_id"), F.col("unit_id").alias("line_id"), "start", "end", "entity_type", F.lit(C.PROPAGATED).alias("source")))
    return boxes_of_spans(spans, lines)


def identity_cards(lines: DataFrame) -> DataFrame:
    """image_id, is_id: whether the words of an image name a document of identity."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "at", "text"))), lambda x: x["text"]), " "))
    cues = F.array(*map(F.lit, sorted(C.ID_CUES)))
    return lines.groupBy("image_id").agg(text.alias("_t")).select("image_id", F.exists(cues, lambda c: F.instr(F.col("_t"), c) > 0).alias("is_id"))


# ---- identity cards: values found by their labels


def _box(words: pd.DataFrame) -> tuple[int, int, int, int]:
    return int(words.left.min()), int(words.top.min()), int((words.left + words.width).max()), int((words.top + words.height).max())


def _key(text: str) -> str:
    return text.lower().strip(" :;.,'’/|-")


_LABEL_WORDS = {w for x in C.ID_LABELS.values() for p in x for w in p.split()}


def _value(words: pd.DataFrame, label: pd.Series) -> pd.DataFrame:
    """Words after a label on its line, up to a wide gap, another label or an unclear word; else the nearest line below."""
    h = label.height
    right = label.left + label.width
    same = words[(words.top < label.top + h) & (words.top + words.height > label.top) & (words.left >= right)].sort_values("left")
    taken, edge = [], right
    for k, w in same.iterrows():
        if w.left - edge > 4 * h or w.conf < 50 or _key(w.text) in _LABEL_WORDS and taken:
            break
        if _key(w.text) in _LABEL_WORDS:  # "Father's Name": the label goes on
            edge = w.left + w.width
            continue
        if _key(w.text):
            taken.append(k)
        edge = w.left + w.width
    if taken:
        return words.loc[taken]
    below = words[(words.top >= label.top + h) & (words.top - label.top - h <= 3 * h) & (words.left < right + 8 * h) & (words.left + words.width > label.left - 2 * h)]
    labelled = words.line_id[words.text.map(_key).isin(_LABEL_WORDS)]
    below = below[~below.line_id.isin(labelled)]
    return below[below.line_id == below.sort_values(["top", "left"]).line_id.iloc[0]] if len(below) else below


def _card(words: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    image = words.image_id.iloc[0] if len(words) else ""
    devanagari = words.text.str.contains("[ऀ-ॿ]", regex=True)

    def add(kind: str, box: tuple, source: str = "id_card") -> None:
        out.append((image, kind, *(int(x) for x in box), source))

    def person(found: pd.DataFrame) -> None:
        add("PERSON", _box(found))
        l, t, r, b = _box(found)
        h = b - t
        twin = words[devanagari & (words.top + words.height <= t) & (t - words.top - words.height <= 2.5 * h) & (words.left < r) & (words.left + words.width > l)]
        if len(twin):
            add("PERSON", _box(twin), "script_twin")

    for _, w in words.iterrows():
        kinds = {k for k, labels in C.ID_LABELS.items() if any(_key(w.text) in p.split() for p in labels)}
        h = w.height
        if kinds & {"name", "father"}:
            found = _value(words, w)
            found = found[found.text.str.contains("[^\\W\\d_]", regex=True)] if len(found) else found
            if len(found):
                person(found)
            elif any("ऀ" <= c <= "ॿ" for c in w.text):
                add("PERSON", (w.left + w.width, w.top, w.left + w.width + 8 * h, w.top + h), "blind")
            if "father" in kinds:  # the holder's own name stands above the father's
                above = words[(words.top + words.height <= w.top) & (w.top - words.top - words.height <= 3 * h) & ~words.text.map(_key).isin(_LABEL_WORDS) & words.text.str.fullmatch("[^\\W\\d_]+[.]?")]
                if len(above):
                    last = above.sort_values("top").line_id.iloc[-1]
                    person(above[above.line_id == last])
        elif "dob" in kinds:
            found = _value(words, w)
            found = found[found.text.str.contains("[0-9]", regex=True)] if len(found) else found
            if len(found):
                add("DATE_OF_BIRTH", _box(found))
        elif "address" in kinds:
            column = words[(words.top + words.height > w.top) & (words.left + words.width > w.left) & (words.index != w.name)]
            pin = column[column.text.str.contains("[1-9][0-9]{5}", regex=True) & (column.top - w.top <= 10 * h)]
            limit = pin.top.min() + h if len(pin) else w.top + 5 * h
            found = column[column.top < limit]
            if len(found):
                add("ADDRESS", _box(found))
        elif "signature" in kinds:
            add("SIGNATURE", (w.left - h, max(0, w.top - 4 * h), w.left + w.width + h, w.top))
    return pd.DataFrame(out, columns=["image_id", "entity_type", "l", "t", "r", "b", "source"])


def card_boxes(lines: DataFrame, identity: DataFrame) -> DataFrame:
    """Boxes that the rules of identity cards give, for images that are such."""
    return lines.join(identity.where("is_id").select("image_id"), "image_id", "left_semi").groupBy("image_id").applyInPandas(_card, BOXES)


# ---- geometry


def area(b: Column) -> Column:
    return F.greatest(b["r"] - b["l"], F.lit(0)) * F.greatest(b["b"] - b["t"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by joint area of two boxes (structs of l, t, r, b); 0 for empty ones."""
    shared = F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0)) * F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0))
    return F.coalesce(F.try_divide(shared.cast("double"), area(a) + area(b) - shared), F.lit(0.0))


def agreeing(a: DataFrame, b: DataFrame, least: float = 0.4) -> DataFrame:
    """Boxes of a that some box of b in the same image overlaps enough: two detectors must agree."""
    box = lambda p: F.struct(*(F.col(f"{p}.{x}") for x in "ltrb"))
    return a.alias("x").join(b.alias("y"), (F.col("x.image_id") == F.col("y.image_id")) & (iou(box("x"), box("y")) > least), "left_semi")


def without(a: DataFrame, b: DataFrame, least: float = 0.2) -> DataFrame:
    """Boxes of a that overlap none of b in the same image by more than that."""
    box = lambda p: F.struct(*(F.col(f"{p}.{x}") for x in "ltrb"))
    return a.alias("x").join(b.alias("y"), (F.col("x.image_id") == F.col("y.image_id")) & (iou(box("x"), box("y")) > least), "left_anti")


def expanded_faces(faces: DataFrame) -> DataFrame:
    """Face boxes with hair, ears and neck."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    return faces.select("image_id", F.lit("FACE").alias("entity_type"), (F.col("l") - 0.6 * w).cast("int").alias("l"), (F.col("t") - 0.7 * h).cast("int").alias("t"), (F.col("r") + 0.6 * w).cast("int").alias("r"), (F.col("b") + 1.0 * h).cast("int").alias("b"), F.lit("face").alias("source"))


def code_boxes(codes: DataFrame, public_host: Callable[[Column], Column], textures: DataFrame | None = None, identity: DataFrame | None = None) -> DataFrame:
    """Boxes of two-dimensional codes (image_id, payload, l, t, r, b) but those that lead to public sites; on identity
    cards also code-like textures that none of these explains."""
    public = F.coalesce(public_host(host_of(F.col("payload"))), F.lit(False))
    boxes = codes.where(~public).select("image_id", F.lit("QR_CODE").alias("entity_type"), "l", "t", "r", "b", F.lit("code").alias("source"))
    if textures is not None and identity is not None:
        rest = without(textures.join(identity.where("is_id").select("image_id"), "image_id", "left_semi"), codes)
        boxes = boxes.unionByName(rest.select("image_id", F.lit("QR_CODE").alias("entity_type"), "l", "t", "r", "b", F.lit("texture").alias("source")))
    return boxes


def _around(values: np.ndarray, reach: int) -> np.ndarray:
    """Means of the squares around each place, cut off at the edges."""
    sums = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = (np.arange(n) for n in values.shape)
    t, b, l, r = (y - reach).clip(0), (y + reach + 1).clip(max=values.shape[0]), (x - reach).clip(0), (x + reach + 1).clip(max=values.shape[1])
    return (sums[b][:, r] - sums[t][:, r] - sums[b][:, l] + sums[t][:, l]) / np.outer(b - t, r - l)


def closed(cells: np.ndarray) -> np.ndarray:
    """Morphological closing by a square of three: gaps of one cell are filled."""
    wide = np.pad(_around(cells.astype(float), 1) > 0, 1, constant_values=True)
    return _around(wide.astype(float), 1)[1:-1, 1:-1] > 1 - 1e-9


def textures(images: DataFrame) -> DataFrame:
    """Code-like textures of raw images: image_id, l, t, r, b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *b) for i, h, w, c, d in zip(batch.image_id, batch.height, batch.width, batch.channels, batch.data, strict=True) for b in texture(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c)))]
            yield pd.DataFrame(found, columns=["image_id", "l", "t", "r", "b"])

    return images.where("data is not null").select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id string, l int, t int, r int, b int")


def texture(pixels: np.ndarray, cell: int = 16) -> list[tuple[int, int, int, int]]:
    """Square, filled regions that change between dark and light as often as printed codes do; darkness is told from what
    is around, and gaps in a region are closed."""
    grey = pixels[..., :3].mean(2) if pixels.ndim == 3 else pixels.astype(float)
    h, w = (x // cell * cell for x in grey.shape)
    if min(h, w) < 4 * cell:
        return []
    dark = grey[:h, :w] < _around(grey, 2 * cell)[:h, :w] - 4
    flips = np.zeros((h, w))
    flips[:, 1:] += dark[:, 1:] != dark[:, :-1]
    flips[1:] += dark[1:] != dark[:-1]
    dense = closed(flips.reshape(h // cell, cell, w // cell, cell).mean((1, 3)) > 0.3)
    out, seen = [], np.zeros_like(dense)
    for i, j in zip(*np.nonzero(dense), strict=True):
        if seen[i, j]:
            continue
        todo, part = [(i, j)], []
        seen[i, j] = True
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < dense.shape[0] and 0 <= b < dense.shape[1] and dense[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    todo.append((a, b))
        ys, xs = [y for y, _ in part], [x for _, x in part]
        bh, bw = max(ys) - min(ys) + 1, max(xs) - min(xs) + 1
        if bh * bw * cell * cell > 0.01 * h * w and 0.7 < bh / bw < 1.4 and len(part) > 0.85 * bh * bw:
            grow = int(0.06 * bh * cell)
            out.append((min(xs) * cell - grow, min(ys) * cell - grow, (max(xs) + 1) * cell + grow, (max(ys) + 1) * cell + grow))
    return out


# ---- pixels


def decode_png(content: bytes) -> np.ndarray | None:
    """Pixels (height, width, channels) of a PNG of 8 bits a channel without interlacing; None for all else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette, head = 8, b"", None, None
    try:
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                data += body
        width, height, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError):
        return None
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if how == 2:
            line = line + above
        elif how in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                up = above[x]
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
                    add = left if pa <= pb and pa <= pc else up if pb <= pc else corner
                line[x] = (line[x] + add) & 255
        above = line & 255
        out[y] = above
    px = out.reshape(height, width, channels)
    return palette[px[..., 0]] if palette is not None and colour == 3 else px


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8 bits a channel."""
    height, width = pixels.shape[:2]
    px = pixels.reshape(height, width, -1)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[px.shape[2]]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), px.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


RAW = "image_id string, height int, width int, channels int, data binary"


def decoded(pictures: DataFrame, decode: Callable[[bytes], np.ndarray | None] = decode_png) -> DataFrame:
    """Pictures (image_id, content) as raw images; what the decoder can't read has null data and is reported as skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for image_id, content in zip(b.image_id, b.content, strict=True):
                px = decode(content) if content else None
                out.append((image_id, None, None, None, None) if px is None else (image_id, *px.reshape(*px.shape[:2], -1).shape, px.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "data"])

    return pictures.select("image_id", "content").mapInPandas(run, RAW)


def encoded(images: DataFrame, encode: Callable[[np.ndarray], bytes] = encode_png) -> DataFrame:
    """image_id and content of painted raw images, to be put back where they came from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, encode(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c)))) for i, h, w, c, d in zip(b.image_id, b.height, b.width, b.channels, b.data, strict=True)]
            yield pd.DataFrame(out, columns=["image_id", "content"])

    return images.where("modified").select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id string, content binary")


def painted(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int = 4) -> np.ndarray:
    """A copy with opaque black boxes, padded and clipped to the image; an alpha channel stays opaque there."""
    out = pixels.copy()
    for l, t, r, b in boxes:
        y, x = slice(max(0, t - pad), max(0, b + pad)), slice(max(0, l - pad), max(0, r + pad))
        out[y, x] = 0
        if out.ndim == 3 and out.shape[2] in (2, 4):
            out[y, x, -1] = 255
    return out


def paint(images: DataFrame, boxes: DataFrame, pad: int = 4) -> DataFrame:
    """Raw images (image_id, height, width, channels, data) with their boxes painted; those without any stay as they are."""
    found = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("l", "t", "r", "b"))).alias("_boxes"))
    rows = images.join(found, "image_id", "left")

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, of: pd.Series) -> pd.Series:
        made = []
        for x in zip(data, h, w, c, of, strict=True):
            px = np.frombuffer(x[0], np.uint8).reshape(int(x[1]), int(x[2]), int(x[3]))
            made.append(painted(px, [(b["l"], b["t"], b["r"], b["b"]) for b in x[4]], pad).tobytes())
        return pd.Series(made)

    none = F.array().cast("array<struct<l:int,t:int,r:int,b:int>>")
    new = F.when(F.col("_boxes").isNotNull(), run("data", "height", "width", "channels", F.coalesce("_boxes", none))).otherwise(F.col("data"))
    return rows.withColumn("modified", F.col("_boxes").isNotNull()).withColumn("data", new).drop("_boxes")


def coverage(images: DataFrame, gold: DataFrame) -> DataFrame:
    """gold boxes (image_id, text, pii, box) with covered: the share of their pixels that are black in all channels."""

    @F.pandas_udf("double")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, box: pd.Series) -> pd.Series:
        out = []
        for x in zip(data, h, w, c, box, strict=True):
            px = np.frombuffer(x[0], np.uint8).reshape(int(x[1]), int(x[2]), int(x[3]))[..., :3]
            l, t, r, b = (int(round(v)) for v in x[4])
            part = (px[max(0, t) : b, max(0, l) : r] < 40).all(2)
            out.append(float(part.mean()) if part.size else 0.0)
        return pd.Series(out)

    return gold.join(images.select("image_id", "data", "height", "width", "channels"), "image_id").withColumn("covered", run("data", "height", "width", "channels", "box")).drop("data", "height", "width", "channels")


def large_enough(images: DataFrame, least: int = 100) -> DataFrame:
    """Images in which a face may be looked for."""
    return images.where(F.least("height", "width") >= least)


def reports(images: DataFrame, lines: DataFrame, identity: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row for each image: size, word count, is_id, boxes as [x, y, w, h], modified, or skipped if it can't be read."""
    words = lines.groupBy("image_id").agg(F.count("*").alias("words"))
    box = F.struct("entity_type", F.array("l", "t", F.col("r") - F.col("l"), F.col("b") - F.col("t")).alias("box"), "source")
    found = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    out = images.join(words, "image_id", "left").join(identity, "image_id", "left").join(found, "image_id", "left")
    return out.select("image_id", "height", "width", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("is_id", F.lit(False)).alias("is_id"), "boxes", F.col("boxes").isNotNull().alias("modified"), F.col("data").isNull().alias("skipped"))
