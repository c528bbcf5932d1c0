"""Exact and near duplicates with classes, canonical rows and exports.

Copies (equal hash form) are collapsed first, so all pair work is between
different texts. Near duplicates use a prefix join: shingles that stand in many
texts are ordered last, each text is looked up under its first few shingles
only, and candidates are verified by the similarity of all of their shingles
(as 64-bit hashes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.session import cut

#: Words of a shingle, similarity of near duplicates, longest length ratio, fewest words of a candidate.
SHINGLE, SIMILAR, LENGTH_RATIO, LEAST_WORDS = 5, 0.85, 1.6, 80
#: Buckets of more than COMMON texts come after the others in every text's order, the more frequent the later.
COMMON = 20
#: Buckets in which shingles are counted for every text's order, and the slices in which the counts are added.
COUNTERS, SLICES = 1 << 22, 64
#: The texts of a shingle in more texts than CROWDED are paired in PARTS x PARTS blocks.
CROWDED, PARTS = 1_000, 8


def exact_classes(docs: DataFrame, key: str = "doc_id", column: str = "text", length: int | None = None) -> DataFrame:
    """(key, class_id, class_size): texts with equal hash form share the least id; blank and null texts are no one's copy.

    ``length`` compares that many characters of the hash form, None all.
    """
    hashed = docs.where(F.col(key).isNotNull()).select(key, t.text_key(F.col(column), length).alias("h"))
    sizes = hashed.where("h is not null").groupBy("h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    filled = hashed.where("h is not null").join(sizes, "h").select(key, "class_id", "class_size")
    return filled.unionByName(hashed.where("h is null").select(key, F.col(key).alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def representatives(docs: DataFrame, key: str = "doc_id", column: str = "text", least_words: int = LEAST_WORDS, k: int = SHINGLE) -> DataFrame:
    """(id, form): the hash form of each text with at least ``least_words`` words and a shingle; ``near_pairs`` lets the least id of its copies stand for a text."""
    # Exploded, the form is made once and not again for each condition on it.
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array(t.hash_form(F.col(column)))).alias("form")).where(
        (F.col("form") != "") & (F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1 >= max(least_words, k)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_shingles(forms: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each hash form as 64-bit hashes, sorted by both; and the words of each form."""
    lists = pc.split_pattern(forms.cast(pa.string()), " ")
    words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    of = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = of[coded.indices.to_numpy(zero_copy_only=False)]
    n = max(len(each) - k + 1, 0)
    runs = each[:n].copy()
    for i in range(1, k):
        runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + each[i:n + i])
    row = np.repeat(np.arange(len(words)), words)[:n]
    whole = np.arange(n) + k <= np.cumsum(words)[row]
    row, runs = row[whole], runs[whole]
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])
    return row[first], runs[first], words


def _frequencies(reps: DataFrame, k: int) -> np.ndarray:
    """How many texts hold shingles of each of ``COUNTERS`` buckets, over all texts: each task sums up a table of its own, and the tables are added in slices."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.uint64)
        for batch in batches:
            _, runs, _ = hashed_shingles(batch.column(0), k)
            table += np.bincount((runs & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
        if table.any():
            for i, part in enumerate(np.split(table, SLICES)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint64) for c in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 2 ** 32 - 1).astype(np.uint32).tobytes(), 1)]})

    schema = "slice int, counts binary"
    table = np.zeros(COUNTERS, np.uint32)
    for r in reps.select("form").mapInArrow(count, schema).groupBy("slice").applyInPandas(add, schema).collect():
        table[r[0] * (COUNTERS // SLICES):(r[0] + 1) * (COUNTERS // SLICES)] = np.frombuffer(zlib.decompress(r[1]), np.uint32)
    return table


def _prefixes(reps: DataFrame, similar: float, k: int) -> DataFrame:
    """(g, block, s, at): each text ``s`` (a hash of its form) under the first shingles of its order, with its number of shingles and the place in the order in ``at``."""
    frequency = _frequencies(reps, k)
    crowded = CROWDED + 4 * int(frequency.mean())  # a bucket holds other shingles too
    common_from = COMMON
    shared = reps.sparkSession.sparkContext.broadcast(frequency)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            row, runs, words = hashed_shingles(batch.column(1), k)
            often = table[(runs & np.uint64(COUNTERS - 1)).astype(np.int64)]
            often[often <= common_from] = 0
            order = np.lexsort((runs, often, row))
            runs, often = runs[order], often[order]
            n = np.bincount(row, minlength=len(words))
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row] + 1
            early = place <= n[row] - np.ceil(n[row] * similar - 1e-9) + 1
            row, runs, often, place = row[early], runs[early], often[early], place[early]
            s = batch.column(0).to_numpy()[row]
            g, at, common = runs.view(np.int64), (n[row] << 32) | place, often > crowded
            own = _part(s)
            blocks = [(~common, 0)] + [(common, 1 + np.minimum(own, q) * PARTS + np.maximum(own, q)) for q in range(PARTS)]
            for chosen, block in blocks:
                if chosen.any():
                    yield pa.RecordBatch.from_pydict({"g": g[chosen], "block": np.broadcast_to(block, len(g))[chosen].astype(np.int32), "s": s[chosen], "at": at[chosen]})

    return reps.select(F.xxhash64("form").alias("s"), "form").mapInArrow(go, "g long, block int, s long, at long")


def _part(s: np.ndarray) -> np.ndarray:
    return (_mixed(s.view(np.uint64)) % np.uint64(PARTS)).astype(np.int64)


def _met(g: np.ndarray, block: np.ndarray, s: np.ndarray, at: np.ndarray, similar: float) -> Iterator[pa.RecordBatch]:
    """(s_1, s_2) of texts of one group (whole groups, sorted) that can be similar, by their numbers of shingles and the shingle's places."""
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (block[1:] != block[:-1]) | (s[1:] != s[:-1])  # copies of a text are one
    g, block, s, at = g[new], block[new], s[new], at[new]
    n, place, part = at >> 32, at & 0xFFFFFFFF, _part(s)
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])]) if len(g) else np.array([], np.int64)
    end = np.repeat(np.r_[starts[1:], len(g)], np.diff(np.r_[starts, len(g)])) if len(g) else starts
    apart = (block > 0) & ((block - 1) // PARTS != (block - 1) % PARTS)
    i, step = np.arange(len(g)), 0
    while len(i := i[i + step + 1 < end[i]]):
        step += 1
        j = i + step
        least = np.ceil(similar / (1 + similar) * (n[i] + n[j]) - 1e-9)
        fits = ((place[i] <= n[i] - least + 1) & (place[j] <= n[j] - least + 1) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similar - 1e-9)
                & (np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= least) & (~apart[i] | (part[i] != part[j])))
        if fits.any():
            yield pa.RecordBatch.from_pydict({"s_1": np.minimum(s[i[fits]], s[j[fits]]), "s_2": np.maximum(s[i[fits]], s[j[fits]])})


def near_pairs(reps: DataFrame, similar: float = SIMILAR, ratio: float = LENGTH_RATIO, k: int = SHINGLE) -> DataFrame:
    """(id_1, id_2, similarity), id_1 < id_2: all pairs of representatives at least ``similar`` by Jaccard of their shingles within the length ratio.

    Two sets as similar as that share one of the first (1 - similar) * n + 1
    members of any common order. The order puts shingles of rare buckets first,
    so a text is found under a common one only if it has nothing else; the texts
    of a crowded shingle are paired in blocks instead of in one task. Only hashes
    of the first shingles are shuffled, once, and texts only to check candidates;
    the order decides what the search costs, not what it finds.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            whole = cut_at > 0 or (kept and (kept[-1][0][-1] != columns[0][-1] or kept[-1][1][-1] != columns[1][-1]))
            if whole:
                yield from _met(*(np.concatenate(c) for c in zip(*kept, [c[:cut_at] for c in columns])), similar)
                kept = []
            kept.append([c[cut_at:] for c in columns])
        if kept:
            yield from _met(*(np.concatenate(c) for c in zip(*kept)), similar)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [hashed_shingles(batch.column(c), k) for c in (2, 3)]
            row, runs = (np.concatenate(x) for x in zip(*(side[:2] for side in sides)))
            order = np.lexsort((runs, row))
            row, runs = row[order], runs[order]
            same = row[1:][(row[1:] == row[:-1]) & (runs[1:] == runs[:-1])]
            common, total = np.bincount(same, minlength=len(batch)), np.bincount(row, minlength=len(batch))
            w_1, w_2 = sides[0][2], sides[1][2]
            share = common / np.maximum(total - common, 1)
            good = (share >= similar) & (np.maximum(w_1, w_2) <= np.minimum(w_1, w_2) * ratio)
            yield pa.RecordBatch.from_pydict({"id_1": batch.column(0).filter(pa.array(good)), "id_2": batch.column(1).filter(pa.array(good)), "similarity": share[good]})

    groups = _prefixes(reps, similar, k).repartition("g", "block").sortWithinPartitions("g", "block", "s")
    met = cut(groups.mapInArrow(meet, "s_1 long, s_2 long").distinct())
    firsts = cut(reps.select(F.xxhash64("form").alias("s"), F.unhex(F.sha1("form")).alias("sha"), "id").groupBy("s", "sha").agg(F.min("id").alias("id")).select("s", "id"))
    of = lambda n: firsts.select(F.col("s").alias(f"s_{n}"), F.col("id").alias(f"x_{n}"))
    pairs = met.join(of(1), "s_1").join(of(2), "s_2").select(F.least("x_1", "x_2").alias("id_1"), F.greatest("x_1", "x_2").alias("id_2")).where("id_1 <> id_2")
    side = lambda n: reps.select(F.col("id").alias(f"id_{n}"), F.col("form").alias(f"form_{n}"))
    kind = reps.schema["id"].dataType.simpleString()
    scored = pairs.join(side(1).hint("shuffle_merge"), "id_1").join(side(2).hint("shuffle_merge"), "id_2").select("id_1", "id_2", "form_1", "form_2").mapInArrow(score, f"id_1 {kind}, id_2 {kind}, similarity double")
    return scored.groupBy("id_1", "id_2").agg(F.round(F.max("similarity"), 4).alias("similarity"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, class_id): the least id of each connected component of (id_1, id_2) edges.

    Large-star and small-star rounds: every round replaces edges by edges to the
    least neighbour, so chains shrink by half and more. Raises if ``most_rounds`` do not suffice.
    """
    now = cut(edges.select(F.least("id_1", "id_2").alias("lo"), F.greatest("id_1", "id_2").alias("hi")).where("lo <> hi").distinct())
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(now.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("lo"), F.col("b").alias("hi")).where("lo <> hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select("e.*").where("lo <> hi").distinct()
        new = cut(small)
        changed = new.select("lo", "hi").exceptAll(now.select("lo", "hi")).limit(1).count() + now.select("lo", "hi").exceptAll(new.select("lo", "hi")).limit(1).count()
        now = new
        if not changed:
            return now.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("class_id")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("class_id")).distinct())
    raise RuntimeError("components did not settle")


def near_classes(docs: DataFrame, key: str = "doc_id", column: str = "text", **how) -> DataFrame:
    """(key, class_id, n_links): each document's class over copies and near duplicates, with its text's links to other texts."""
    exact = exact_classes(docs, key, column)
    pairs = cut(near_pairs(representatives(docs, key, column), **how))
    links = pairs.select(F.explode(F.array("id_1", "id_2")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    joined = components(pairs).select(F.col("id").alias("rep"), F.col("class_id").alias("joined_id"))
    return exact.withColumnRenamed("class_id", "rep").join(joined, "rep", "left").join(links, "rep", "left").select(
        key, F.coalesce("joined_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def canonical(docs: DataFrame, classes: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, class_id, class_size, is_canonical): per class the longest text, then fewest boilerplate hits, then least id is kept."""
    scored = docs.select(key, F.length(F.coalesce(column, F.lit(""))).alias("len"), t.boilerplate_hits(F.col(column)).alias("hits")).join(classes.select(key, "class_id"), key)
    best = scored.groupBy("class_id").agg(F.min(F.struct((-F.col("len")).alias("l"), F.col("hits"), F.col(key))).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return scored.join(best, "class_id").select(key, "class_id", "class_size", (F.col(key) == F.col(f"best.{key}")).alias("is_canonical"))
