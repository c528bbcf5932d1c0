"""Held-out items that leak into a corpus: prefix-filtered set join of word shingles.

Words are compared without case, marks and hidden characters; runs of scripts
without spaces give their letters. Shingles are three words, not five: an item
counts as held from half of its words on, with about one word in ten changed,
which leaves few runs of five.

One pass over whole texts keeps the shingles that some item may have, known by
a table of bits of fixed size. Over these, Spark counts in how many documents
each shingle stands and orders every item's shingles by rarity. A document that
shares enough of an item must share several of its rarest ones (the prefix), so
documents and items are joined on prefix shingles only; pairs then pass bounds
on the shared shingles and on the length. What is left is verified exactly: the
item's words that stand in the document in the item's order, in windows as long
as the item that follow one another, must be about half of the item.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.lines import SPACELESS, SPACELESS_LEAD
from weftline.session import cut

#: Words of a shingle, and the share of an item's distinct shingles that a document must hold to be a candidate.
SHINGLE, LEAST_OVERLAP = 3, 0.25
#: Share of an item's words that a document must hold; unmatched words that a run bridges.
HELD, BRIDGE = 0.48, 5
#: Words of the shortest run: a share of the item, within bounds.
RUN_SHARE, LEAST_RUN, LONGEST_RUN = 0.2, 3, 8
#: Windows of the item's length that may lie between two parts of an item.
WINDOWS = 3
#: Bits of the table that tells which shingles some item may have (8 MB), whatever the number of items.
TABLE_BITS = 26

_STEPS = [(a, b) for a in range(1, BRIDGE + 1) for b in range(max(1, a - 1), min(BRIDGE, a + 1) + 1)]
#: ASCII bytes with all but letters and digits as blanks; signs beyond ASCII that are no part of words; hidden characters.
_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_SIGNS = re.compile("[" + "".join(re.escape(c) for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x10000)]) if not c.isalnum() and unicodedata.category(c)[0] != "M") + "]")
_HIDDEN = re.compile(b"\xc2\xad|\xe2\x80[\x8b-\x8d]|\xe2\x81\xa0|\xef\xbb\xbf")


def words_of(text: str) -> list[str]:
    """Words without case and marks; runs of scripts without spaces as single letters. Hidden characters inside words do not count."""
    raw = text.casefold().encode()
    if raw.isascii():
        return raw.translate(_WORD_BYTES).decode().split()
    words = _SIGNS.sub(" ", _HIDDEN.sub(b"", raw).translate(_WORD_BYTES).decode()).split()
    if not SPACELESS_LEAD.search(raw):
        return words
    out: list[str] = []
    for w in words:
        if not SPACELESS.search(w):
            out.append(w)
            continue
        at = 0
        for m in SPACELESS.finditer(w):
            out += [w[at:m.start()]] if m.start() > at else []
            out += m[0]
            at = m.end()
        out += [w[at:]] if at < len(w) else []
    return out


class Hasher:
    """64-bit hashes of the runs of ``SHINGLE`` words of a text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, hash of each run)."""
        words = words_of(text)
        if len(words) < SHINGLE:
            return len(words), np.zeros(0, np.uint64)
        known = self.known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            ids = [known[w] for w in words]
        h = np.array(ids, np.uint64)
        g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        return len(words), g ^ (g >> np.uint64(32))


def needed(n_shingles: int) -> int:
    """Distinct shingles of an item that a document must share."""
    return max(1, math.ceil(LEAST_OVERLAP * n_shingles))


def covered(matches: list[tuple[int, int]], length: int) -> int:
    """Words of an item that a document holds in order, from the (place in item, place in document) of shared shingles.

    Shingles form runs, which bridge a few changed words (these do not count as
    held). Runs follow one another in item and document, at most ``WINDOWS``
    item lengths apart; the best chain counts.
    """
    runs: list[list[int]] = []
    last: dict[tuple[int, int], list[int]] = {}
    for k, j in sorted(matches):
        best = None
        for a, b in _STEPS:
            r = last.get((k - a, j - b))
            if r is not None and (best is None or r[4] > best[4]):
                best = r
        if best is None:
            best = [k, j, k, j, SHINGLE]
            runs.append(best)
        else:
            if last.get((best[2], best[3])) is best:
                del last[best[2], best[3]]
            best[4] += min(SHINGLE, k - best[2])
        best[2], best[3] = k, j
        last[k, j] = best
    shortest = min(LONGEST_RUN, max(LEAST_RUN, math.ceil(RUN_SHARE * length)))
    long = sorted((r[3] + SHINGLE, r[2] + SHINGLE, r[0], r[1], r[4]) for r in runs if r[2] + SHINGLE - r[0] >= shortest)
    ends = [r[0] for r in long]
    total: list[int] = []
    for n, (_, _, k, j, size) in enumerate(long):
        most = size
        for m in range(bisect.bisect_left(ends, j - WINDOWS * length), min(n, bisect.bisect_right(ends, j + 2))):
            over = long[m][1] - k
            if over <= 2:
                most = max(most, total[m] + size - max(0, over))
        total.append(most)
    return max(total, default=0)


def holds(item: dict[int, list[int]], length: int, shingles: list[int], places: list[int]) -> bool:
    """Whether a document with these shingles holds the item (shingle -> places, words)."""
    matches = [(k, j) for g, j in zip(shingles, places) for k in item.get(g, ())]
    return covered(matches, length) >= HELD * length


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, item_hash, n_words, shingles, n_shingles) per item and text; ``shingles`` in order, ``n_shingles`` distinct ones. Items of fewer than three words have no row."""
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            got = [hasher.shingles(t) for t in pdf["text"]]
            out = pdf[["item_id", "item_hash"]].assign(n_words=[n for n, _ in got], shingles=[g.view(np.int64) for _, g in got], n_shingles=[len(np.unique(g)) for _, g in got])
            yield out[out["n_shingles"] > 0]

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text")
    return rows.dropDuplicates(["item_id", "item_hash"]).mapInPandas(go, "item_id long, item_hash long, n_words int, shingles array<long>, n_shingles int")


def shingle_table(held: DataFrame) -> np.ndarray:
    """Bits of ``TABLE_BITS`` places, set for the items' shingles: what reaches the driver is bounded whatever the number of items."""
    slots = held.select(F.explode("shingles").alias("g")).select(F.shiftrightunsigned("g", 64 - TABLE_BITS).alias("slot"))
    bits = slots.select(F.expr("cast(shiftright(slot, 6) as int)").alias("i"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b"))
    got = bits.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[got["i"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return table


def spotted(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, doc_hash, n_words, shingles, places) of the documents with shingles that items may have, from one pass over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, bits = Hasher(), shared.value
        for pdf in batches:
            rows = []
            for doc_id, doc_hash, text in zip(pdf["doc_id"], pdf["doc_hash"], pdf["text"]):
                n, g = hasher.shingles(text)
                slot = g >> np.uint64(64 - TABLE_BITS)
                at = np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                if len(at):
                    rows.append((doc_id, doc_hash, n, g[at].view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_hash", "n_words", "shingles", "places"])

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), "text")
    return rows.mapInPandas(go, "doc_id long, doc_hash long, n_words int, shingles array<long>, places array<int>")


def candidates(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, item_id, item_hash) that share enough prefix shingles and pass the bound on the length.

    Of an item's n distinct shingles a document must share m. If the item's
    shingles are ordered by how many documents have them, at most m - j of the shared ones lie
    behind the first n - m + j, so at least j lie among them; j is half of m.
    """
    hits = docs.select("doc_id", "doc_hash", "n_words", F.explode(F.array_distinct("shingles")).alias("g"))
    seen = hits.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = held.select("item_id", "item_hash", F.col("n_words").alias("item_words"), "n_shingles", F.explode(F.array_distinct("shingles")).alias("g")).join(seen, "g", "left")
    m = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * LEAST_OVERLAP))
    j = F.ceil(m / 2)
    place = F.row_number().over(Window.partitionBy("item_id", "item_hash").orderBy(F.coalesce("df", F.lit(0)), "g"))
    prefix = own.withColumn("place", place).where((F.col("place") <= F.col("n_shingles") - m + j) & F.col("df").isNotNull()).select("g", "item_id", "item_hash", "item_words", j.alias("least"))
    pairs = hits.join(prefix, "g").where(F.col("n_words") >= F.col("item_words") * HELD)
    return pairs.groupBy("doc_id", "doc_hash", "item_id", "item_hash").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").drop("n", "least")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for each document that holds an item, wholly or about half of its words in order.

    Rows with null ids or texts and items of fewer than three words give
    nothing; repeated rows give one pair. A shorter run than a fifth of the item
    (three to eight words) does not count, nor do parts more than ``WINDOWS``
    item lengths apart. Texts are read once, whatever the number of items.
    """
    held = cut(item_shingles(items))
    docs = cut(spotted(documents, shingle_table(held)))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for doc_id, item_id, n, own, shingles, places in zip(pdf["doc_id"], pdf["item_id"], pdf["item_words"], pdf["own"], pdf["shingles"], pdf["places"]):
                at: dict[int, list[int]] = defaultdict(list)
                for k, g in enumerate(own.tolist()):
                    at[g].append(k)
                shared = shingles.tolist()
                if len(at.keys() & set(shared)) >= needed(len(at)) and holds(at, n, shared, places.tolist()):
                    hits.append((doc_id, item_id))
            yield pd.DataFrame(hits, columns=["doc_id", "item_id"], dtype="int64")

    once = docs.dropDuplicates(["doc_id", "doc_hash"]).select("doc_id", "doc_hash", "shingles", "places")
    full = candidates(docs.dropDuplicates(["doc_id", "doc_hash"]), held).join(held.select("item_id", "item_hash", F.col("n_words").alias("item_words"), F.col("shingles").alias("own")), ["item_id", "item_hash"])
    return full.join(once, ["doc_id", "doc_hash"]).select("doc_id", "item_id", "item_words", "own", "shingles", "places").mapInPandas(go, "doc_id long, item_id long").distinct()


def leaked_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents): each item that leaked, with the number of documents that hold it."""
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents")).join(items.select("item_id", "suite").distinct(), "item_id").select("item_id", "suite", "n_documents")
