"""Main text of web pages by differencing with the pages whose URLs are nearest.

Markup names part of a page's frame (menus, footers, adverts); these lines go. The others are candidates. Candidate
lines of one host's pages are sorted by path, by ranges of (host, path), so that a host with a third of all pages lies
in many tasks; pages with the same lines are one there, so copies are no neighbours of each other. Each page's lines
are aligned with those of its two nearest by a longest common subsequence, and lines that they share are the site's
template and are deleted. Pages meet their neighbours by their rank in the order, keys of at most five rows, and only
line hashes move.

A neighbour is a copy and tells nothing about the template if neither page has a line that the other does not share, but
for short ones with digits (of fewer than LETTERS letters): copies may differ in a date or a counter, while two short
notes under one menu do not make each other copies.
Lines inside a declared content element (article, main) are kept even if they are shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import met
from tessera.llm.markup import text_blocks
from tessera.llm.shared import bounded_batches, read, written

#: Cells of an alignment table that are held at once.
CELLS = 1 << 22
#: Letters from which on a line that is not shared tells two pages apart if it holds a digit; others need one.
LETTERS = 20

PARSED = "page_id long, url string, host string, path string, content long, blocks array<string>, sure array<boolean>, hashes array<long>, letters array<int>"


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        take = row[:-1] + (b == x)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], take))
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a lie in a longest common subsequence with b."""
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(np.isin(a, b))
    b = b[np.isin(b, a)]
    if len(at):
        out[at] = _common(a[at], b)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    out[:head] = True
    a, b, rest = a[head:], b[head:], out[head:]
    if not len(a) or not len(b):
        return out
    if len(a) == 1:
        rest[:] = a[0] in b
        return out
    if len(a) * len(b) > CELLS:  # halve a, and part b where both halves together are longest
        mid = len(a) // 2
        part = int(np.argmax(_last_row(a[:mid], b) + _last_row(a[mid:][::-1], b[::-1])[::-1]))
        rest[:mid], rest[mid:] = _common(a[:mid], b[:part]), _common(a[mid:], b[part:])
        return out
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == x)))
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            rest[i - 1] = True
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out


def _where(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", url or ""


def _letters(line: str) -> int:
    """Letters of a short line with a digit, as dates and counters are; all other lines with letters have enough."""
    if len(line) < 100:
        n = sum(map(str.isalpha, line))
        return n if n == 0 or any(map(str.isdigit, line)) else max(n, LETTERS)
    return len(line)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.string())), ("sure", pa.list_(pa.bool_())), ("hashes", pa.list_(pa.int64())), ("letters", pa.list_(pa.int32()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for page_id, url, source in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("page_id", "url", "html"))):
                found = [(b, inside) for b, frame, inside in text_blocks(source or "") if not frame]
                hashes = np.array([xxhash.xxh64_intdigest(b) for b, _ in found], np.uint64).view(np.int64)
                content = xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)
                rows.append((page_id, url, *_where(url), content, [b for b, _ in found], [s for _, s in found], hashes, [_letters(b) for b, _ in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(n, n + batch.num_rows))], [*batch.schema.names, "part", "place"])
        n += batch.num_rows


def shared_lines(own: np.ndarray, letters: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which lines of a page its neighbours (lines, letters) share; a copy is not counted."""
    shared = np.zeros(len(own), bool)
    for other, other_letters in others:
        common = common_lines(own, other)
        if (letters[~common] >= LETTERS).any() or (other_letters[~common_lines(other, own)] >= LETTERS).any():
            shared |= common
    return shared


def _template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for near in batch.column("near").to_pylist():
            at = {x["k"]: x for x in near}
            own = at[0]
            same = {k: (np.array(x["hashes"], np.int64), np.array(x["letters"], np.int64)) for k, x in at.items() if x["host"] == own["host"]}
            chosen = [k for k in (-1, 1, -2, 2) if k in same][:2]
            shared = shared_lines(*same[0], [same[k] for k in chosen])
            found.append((own["host"], own["content"], np.flatnonzero(shared).astype(np.int32)))
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int32())))], ["host", "content", "shared"])


#: A page has lines that markup leaves undecided.
LOOSE = "exists(sure, x -> not x)"


def template_lines(parsed: DataFrame) -> DataFrame:
    """(host, content, shared): of each host's distinct lists of lines, those shared with the nearest pages.

    Lists of lines that all lie in declared content elements are neighbours, but nothing is asked of them.
    """
    n = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = parsed.groupBy("host", "content").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("letters").alias("letters"), F.max(F.expr(LOOSE)).alias("loose"))
    order = ["host", "path", "content"]
    fields = "host string, path string, content long, hashes array<long>, letters array<int>, loose boolean, part int, place long"
    ordered = lines.select("host", "path", "content", "hashes", "letters", "loose").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = written(ordered.mapInArrow(_numbered, fields), "ordered")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    ranked = ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("first") + F.col("place"))  # a row for each task that sorted
    line = F.struct(F.col("k"), "host", "content", "hashes", "letters", "loose")
    sent = ranked.withColumn("k", F.explode(F.array(*map(F.lit, range(-2, 3))))).select((F.col("rank") - F.col("k")).alias("rank"), line.alias("line"))
    near = sent.groupBy("rank").agg(F.collect_list("line").alias("near"))  # five at most
    return near.where(F.exists("near", lambda x: (x["k"] == 0) & x["loose"])).select("near").mapInArrow(_template, "host string, content long, shared array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages (page_id long, url string, html string, ...).

    text has the blocks of the main text in page order with an empty line between; it is empty where there is none,
    as for null and empty html. Pages without a URL are neighbours of each other. Rows that repeat a page_id each get
    a row; copies of a page have one text, which they do not take from each other. An empty table gives none. Other
    columns are not read.
    """
    bounded_batches(pages.sparkSession)
    parsed = written(pages.select("page_id", "url", "html").mapInArrow(_parsed, PARSED), "parsed")
    shared = written(template_lines(parsed), "template", True).where(F.size("shared") > 0)
    sure = parsed.where(f"not {LOOSE}").withColumn("shared", F.lit(None).cast("array<int>"))
    pages = sure.unionByName(met(parsed.where(LOOSE), shared, "content", "page_id", "left", ["host"]))
    lines = F.arrays_zip("blocks", "sure", F.sequence(F.lit(0), F.size("blocks")).alias("place"))
    gone = F.coalesce("shared", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x: x["blocks"].isNotNull() & (x["sure"] | ~F.array_contains(gone, x["place"])))
    return pages.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["blocks"]), "\n\n").alias("text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
