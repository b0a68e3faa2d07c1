"""Word positions and highlights."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

BOX = ("x_min", "y_min", "x_max", "y_max")


def word_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, page, word_offset, word_text) of pages (doc_id, page, text): tokens numbered through the document.

    A page's tokens are counted first and offset by the pages before it, so no document's words meet in one task.
    """
    toks = pages.select("doc_id", "page", T.tokens(F.col("text")).alias("t"))
    before = F.sum(F.size("t")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = toks.withColumn("base", F.coalesce(before, F.lit(0)))
    return placed.select("doc_id", "page", "base", F.posexplode("t").alias("i", "word_text")).select("doc_id", "page", (F.col("base") + F.col("i")).cast("int").alias("word_offset"), "word_text")


def grid_boxes(words: DataFrame) -> DataFrame:
    """Positions on a regular grid: 250 words a page, 8 a line."""
    i = F.col("word_offset")
    line, col = F.floor(F.pmod(i, F.lit(250)) / 8), F.pmod(F.pmod(i, F.lit(250)), F.lit(8))
    x, y = (50 + 70 * col).cast("float"), (750 - 15 * line).cast("float")
    return words.select("doc_id", "word_offset", (1 + F.floor(i / 250)).cast("int").alias("page"), x.alias("x_min"), y.alias("y_min"), (x + 60).cast("float").alias("x_max"), (y + 12).cast("float").alias("y_max"), "word_text")


def grid_places(i: np.ndarray) -> tuple[np.ndarray, ...]:
    """Page and box of words at such offsets, as grid_boxes gives them."""
    x, y = (50 + 70 * (i % 250 % 8)).astype(np.float32), (750 - 15 * (i % 250 // 8)).astype(np.float32)
    return (1 + i // 250).astype(np.int32), x, y, x + np.float32(60), y + np.float32(12)


def single_term(positions: DataFrame, term: str) -> DataFrame:
    return positions.where(F.lower("word_text") == term.lower())


def at_offsets(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Positions whose (doc_id, word_offset) the other table holds."""
    return positions.join(offsets, ["doc_id", "word_offset"], "left_semi")


def occurrences(positions: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Words of every occurrence of each group on one page, with group_no, start_offset and j, the word's place in its group.

    One pass over the positions whatever the groups: only the groups' own terms are kept, and each page's are brought
    together by offset, all the words of one offset in one row. A row that starts an occurrence holds the rows after it.
    """
    groups = [[t.lower() for t in g] for g in groups]
    own = positions.select("*", F.lower("word_text").alias("_w")).where(F.col("_w").isin(sorted({t for g in groups for t in g}))).repartition("doc_id", "page")
    cells = own.groupBy("doc_id", "page", "word_offset").agg(F.collect_list(F.struct("_w", *positions.columns)).alias("_r"))
    by_offset = Window.partitionBy("doc_id", "page").orderBy("word_offset")
    for j in range(1, max(map(len, groups))):
        follows = F.lead("word_offset", j).over(by_offset) == F.col("word_offset") + j
        cells = cells.withColumn(f"_r{j}", F.when(follows, F.lead("_r", j).over(by_offset)))
    at = lambda j: F.col(f"_r{j}" if j else "_r")
    found = []
    for n, group in enumerate(groups):
        known = F.lit(len(group) == 1) | (F.col("doc_id").isNotNull() & F.col("page").isNotNull())  # what is unknown has no neighbours
        holds = reduce(lambda a, b: a & b, [known, *[F.coalesce(F.exists(at(j), _is(t)), F.lit(False)) for j, t in enumerate(group)]])
        rows = F.flatten(F.array(*[F.transform(F.filter(at(j), _is(t)) if len(group) == 1 else at(j), _placed(n, j)) for j, t in enumerate(group)]))
        found.append(F.when(holds, rows))
    out = cells.select("doc_id", "page", F.col("word_offset").alias("start_offset"), F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("_o"))
    return out.select("start_offset", "_o.group_no", "_o.j", *[c if c in ("doc_id", "page") else F.col(f"_o.word.{c}").alias(c) for c in positions.columns])


def _is(term: str):
    return lambda x: x["_w"] == term


def _placed(group: int, place: int):
    return lambda x: F.struct(F.lit(group).alias("group_no"), F.lit(place).alias("j"), x.alias("word"))


def phrase(positions: DataFrame, terms: list[str]) -> DataFrame:
    """Words of every occurrence of a phrase on one page, with start_offset and j, the word's place in the phrase."""
    return occurrences(positions, [terms]).drop("group_no")


def distinct_boxes(found: DataFrame, order: list[str]) -> DataFrame:
    """The first of the words on a page whose boxes start within the same hundredth."""
    key = ["doc_id", "page", (F.col("x_min") * 100).cast("int"), (F.col("y_min") * 100).cast("int")]
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: Words that document_boxes looks at together, or one document's.
CHUNK = 1 << 16


def starts(x_min: np.ndarray, y_min: np.ndarray, x_max: np.ndarray, y_max: np.ndarray) -> list[np.ndarray]:
    """What distinct_boxes tells boxes apart by."""
    return [np.trunc(v * np.float32(100)).astype(np.int64) for v in (x_min, y_min)]


def edges(*box: np.ndarray) -> list[np.ndarray]:
    """What ui_boxes tells boxes apart by."""
    return list(box)


def document_boxes(docs: DataFrame, layout: Callable[[np.ndarray], tuple[np.ndarray, ...]], apart: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(doc_id, word_offset, page, box, word_text) of documents whose words are in one row (doc_id, words): the first word
    by offset of each box of a page, in order of page and offset.

    ``distinct_boxes`` (apart: starts) and ``ui_boxes`` (apart: edges) of the documents' words, without a row for each word
    and without an exchange. layout gives page and box of the words at such offsets.
    """

    def first(doc: np.ndarray, offset: np.ndarray) -> np.ndarray:
        page, *box = layout(offset)
        keys = [doc, page, *apart(*box)]
        by_key = np.lexsort((offset, *keys[::-1]))
        new = np.ones(len(by_key), bool)
        if len(new) > 1:
            new[1:] = reduce(np.logical_or, [k[by_key[1:]] != k[by_key[:-1]] for k in keys])
        kept = by_key[new]
        return kept[np.lexsort((offset[kept], page[kept], doc[kept]))]

    def run(batches):
        for batch in batches:
            words = batch.column(1)
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, ends = words.flatten(), np.concatenate(([0], np.cumsum(sizes)))
            row = 0
            while row < len(sizes):
                until = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
                doc = np.repeat(np.arange(row, until), sizes[row:until])
                offset = (np.arange(ends[row], ends[until]) - ends[doc]).astype(np.int32)
                if len(doc):
                    kept = first(doc, offset)
                    page, *box = layout(offset[kept])
                    own = [batch.column(0).take(pa.array(doc[kept])), pa.array(offset[kept]), pa.array(page.astype(np.int32)), *[pa.array(v.astype(np.float32)) for v in box]]
                    yield pa.RecordBatch.from_arrays([*own, flat.take(pa.array(kept + ends[row]))], names=schema.names)
                row = until

    schema = S.StructType([S.StructField("doc_id", docs.schema["doc_id"].dataType), S.StructField("word_offset", S.IntegerType()), S.StructField("page", S.IntegerType()), *[S.StructField(b, S.FloatType()) for b in BOX], S.StructField("word_text", S.StringType())])
    return docs.select("doc_id", "words").mapInArrow(run, schema)


def term_positions(positions: DataFrame, matched_terms: list[str], groups: list[list[str]]) -> DataFrame:
    """Boxes to highlight: groups of one word anywhere, longer ones only as phrases on one page; without repeats."""
    if not matched_terms or not groups:
        return positions.limit(0)
    found = occurrences(positions, groups)
    return distinct_boxes(found, ["group_no", "start_offset", "j"]).orderBy("doc_id", "group_no", "start_offset", "j").select("doc_id", "word_offset", "page", *BOX, "word_text")


def phrase_starts(found: DataFrame, n_terms: int) -> DataFrame:
    """Adds is_start: a row that does not follow the word before it on the same page; all rows if there is one term."""
    w = Window.partitionBy("doc_id").orderBy("page", "word_offset")
    new = F.lag("page").over(w).isNull() | (F.lag("page").over(w) != F.col("page")) | (F.lag("word_offset").over(w) + 1 != F.col("word_offset"))
    return found.withColumn("is_start", F.lit(True) if n_terms <= 1 else new)


def neighbours(found: DataFrame) -> DataFrame:
    """Adds the offsets of the matches before and after each one."""
    w = Window.partitionBy("doc_id").orderBy("page", "word_offset")
    return found.withColumn("previous_offset", F.lag("word_offset").over(w)).withColumn("next_offset", F.lead("word_offset").over(w))


def matching_pages(found: DataFrame) -> DataFrame:
    """Zero-based pages with a match."""
    return found.select("doc_id", (F.col("page") - 1).alias("page_index")).where("page_index >= 0").distinct()


def by_page(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("word_offset", *[c for c in (*BOX, "word_text") if c in found.columns]))).alias("words"))


def term_offsets(docs: DataFrame, term: str) -> DataFrame:
    """(doc_id, word_offset) of one exact term in all documents (doc_id, content)."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("content"))).alias("word_offset", "term")).where(F.col("term") == term).select("doc_id", "word_offset")


def nearest_pages(pages: DataFrame, centre: Column) -> DataFrame:
    """Pages (doc_id, page, y_centre) of each document with their place by distance from a viewport's centre."""
    near = Window.partitionBy("doc_id").orderBy(F.abs(F.col("y_centre") - centre), "page")
    return pages.withColumn("place", F.row_number().over(near))


def ui_boxes(found: DataFrame) -> DataFrame:
    """The words that a viewer draws: one for each box of a page, the first by offset; in order of page and offset."""
    first = Window.partitionBy("doc_id", "page", *BOX).orderBy("word_offset")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").orderBy("doc_id", "page", "word_offset")


def _lines(heights: list[int], boxes: list[tuple[int, int, int]]) -> list[list[int]]:
    """Sum of centres, words, top and bottom of a page's lines; boxes (centre, top, bottom) are in order.

    Centres rise, so a line that was too far above one word is too far above all later ones: only the last line is open.
    """
    heights.sort()
    limit = -(-heights[len(heights) // 2] // 2)
    found: list[list[int]] = []
    for c, top, bottom in boxes:
        line = found[-1] if found else None
        if line and abs(c - line[0] // line[1]) <= limit:
            line[:] = [line[0] + c, line[1] + 1, min(line[2], top), max(line[3], bottom)]
        else:
            found.append([c, 1, top, bottom])
    return found


def group_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, top, bottom, n_words) of highlighted words with whole-number boxes (doc_id, page, top, bottom).

    A word joins the first line whose mean centre lies within half the median height; the mean moves with every word, so
    each page is one sequence. Pages come sorted and a task reads them one after the other, a page at a time.
    """

    def run(batches):
        key, heights, boxes, made = None, [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            for doc, page, c, top, bottom in zip(*[x.to_pylist() for x in batch.columns]):
                if key != (doc, page):
                    if boxes:
                        made += [(*key, i, x[2], x[3], x[1]) for i, x in enumerate(_lines(heights, boxes))]
                    key, heights, boxes = (doc, page), [], []
                heights.append(bottom - top)
                boxes.append((c, top, bottom))
            if made:
                yield out()
                made = []
        if boxes:
            made = [(*key, i, x[2], x[3], x[1]) for i, x in enumerate(_lines(heights, boxes))]
            yield out()

    names, types = ["doc_id", "page", "line", "top", "bottom", "n_words"], [pa.int64(), *[pa.int32()] * 5]
    centre = F.shiftright(F.col("top").cast("long") + F.col("bottom").cast("long"), 1).alias("c")
    placed = words.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), centre, "top", "bottom")
    dealt = placed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "c", "top", "bottom")
    return dealt.mapInArrow(run, "doc_id long, page int, line int, top int, bottom int, n_words int")
