"""Images in documents: words read, personal data found, painted over, and put back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import is_public_host
from ..operators import images, recognizers
from ..sources import docx
from ..staging import saved

#: (image_id, content) to words (see ``images.WORDS``), faces (image_id, l, t, r, b) or codes (those and payload).
Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class Pictures:
    """``changed``: doc_id, image_id and content of painted images; ``report``: a row for each image."""

    changed: DataFrame
    report: DataFrame

    def figures(self) -> dict[str, int]:
        n = self.report.agg(F.count("*").alias("images"), F.count_if("modified").alias("images_modified"), F.count_if("skipped").alias("images_skipped")).first()
        return n.asDict()


def redact(docs: DataFrame, known: DataFrame, config: C.RunConfig | None = None, *, reader: Hook | None = None, faces: Hook | None = None, codes: Hook | None = None, stage=saved) -> Pictures:
    """docs: doc_id, path, content; known: doc_id, key, entity_type, names that the documents' texts have.

    Without a reader no words are known, so only faces and codes can be found. Images that can't be decoded (formats
    other than PNG, without a decoder of one's own) stay as they are and are counted as skipped.
    """
    config = config or C.RunConfig()
    pictures = stage(docx.images(docs), "pictures")
    raw = stage(images.decoded(pictures), "raw")
    spark = docs.sparkSession
    content = pictures.select("image_id", "content")
    words = images.recognised_words(content, reader) if reader else spark.createDataFrame([], images.WORDS)
    lines = stage(images.group_lines(images.readable(words)), "lines")
    identity = images.identity_cards(lines)
    by_image = pictures.select("doc_id", "image_id").join(known, "doc_id").select(F.col("image_id").alias("doc_id"), "key", "entity_type")
    boxes = images.card_boxes(lines, identity).unionByName(images.text_boxes(lines, lambda x: recognizers.detect(x, config), by_image, identity))
    place = "image_id string, l int, t int, r int, b int"
    if faces:
        large = images.large_enough(raw.where(F.col("data").isNotNull())).select("image_id")
        boxes = boxes.unionByName(images.expanded_faces(content.join(large, "image_id", "left_semi").mapInPandas(faces, place)))
    known_codes = content.mapInPandas(codes, f"{place}, payload string") if codes else spark.createDataFrame([], f"{place}, payload string")
    cards = raw.join(identity.where("is_id"), "image_id", "left_semi")
    boxes = boxes.unionByName(images.code_boxes(known_codes, is_public_host, images.textures(cards), identity))
    boxes = stage(boxes.distinct(), "boxes")
    painted = images.paint(raw.where(F.col("data").isNotNull()), boxes, config.pad)
    changed = images.encoded(painted).join(pictures.select("doc_id", "image_id"), "image_id").select("doc_id", "image_id", "content")
    report = stage(images.reports(raw, lines, identity, boxes).withColumn("modified", F.col("modified") & ~F.col("skipped")), "image-report")
    return Pictures(stage(changed, "painted"), report)
