"""Near-duplicate records: SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.llm.components import components
from marlinspike.session import ensure_checkpoint_dir

WORD = re.compile(r"[^\W_]+")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(said: list[str], width: int) -> np.ndarray:
    """Distinct sorted 64-bit hashes of all runs of `width` consecutive words; a shorter text is one run."""
    words = np.array([_HASHES[w] for w in said], dtype=np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    run = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] + np.uint64(k + 1))
    return np.unique(run)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of m slots, one row per set; every set must have an element.

    An element walks its own random permutation of the slots; at step j it offers j + r for the slot it comes
    to, so ranks over the slots are correlated and the estimate varies less than with independent hashes. A set
    stops as soon as every slot holds an offer, since later steps only offer more. All sets advance together,
    one numpy operation per step; Fisher-Yates is followed lazily, by looking up earlier swaps.
    """
    sizes = np.array([len(s) for s in sets])
    base, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * m, _EMPTY, dtype=np.uint64)
    swapped: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    low32 = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(m):
            x = _mix(base + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            k = j + (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int16)
            here, there = np.full(len(base), j, dtype=np.int16), k.copy()
            for s, v in zip(swapped, moved):
                np.copyto(here, v, where=s == j)
                np.copyto(there, v, where=s == k)
            np.minimum.at(out, own * m + there, (np.uint64(j) << np.uint64(32)) | (x & low32))
            swapped.append(k)
            moved.append(here)
            done = (out.reshape(-1, m) != _EMPTY).all(axis=1)
            keep = ~done[own]
            if not keep.any():
                break
            if keep.mean() < 0.9:
                base, own = base[keep], own[keep]
                swapped, moved = [s[keep] for s in swapped], [v[keep] for v in moved]
    return out.reshape(-1, m)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` slots."""
    n, m = signatures.shape
    parts = signatures[:, : m // rows * rows].reshape(n, m // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
        for r in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def bit_sketch(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 slots, as two longs."""
    bits = (signatures[:, :128] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _sketcher(width: int, bands: int, rows: int, min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                keys, sets = [], []
                for key, head, body in zip(frame["key"].iloc[at : at + 1000], frame["head"].iloc[at : at + 1000], frame["body"].iloc[at : at + 1000]):
                    said = words_of(body)
                    if len(said) >= min_words:
                        s = shingle_hashes(words_of(head) + said, width)
                        if len(s):
                            keys.append(key)
                            sets.append(s)
                if keys:
                    sig = superminhash(sets, bands * rows)
                    bits, found = bit_sketch(sig), band_keys(sig, rows)
                    yield pd.DataFrame({"band": found.ravel(), "key": np.repeat(np.array(keys, dtype=np.int64), bands), "s1": np.repeat(bits[:, 0], bands), "s2": np.repeat(bits[:, 1], bands)})

    return run


def _verifier(width: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def shingles(key: int, head: str | None, body: str) -> np.ndarray:
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = shingle_hashes(words_of(head) + words_of(body), width)
            return known[key]

        for f in frames:
            keep = []
            for a, ha, ba, b, hb, bb in zip(f["a"], f["head_a"], f["body_a"], f["b"], f["head_b"], f["body_b"]):
                x, y = shingles(a, ha, ba), shingles(b, hb, bb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both))
            f = f.assign(similarity=keep)
            yield f.loc[f["similarity"] >= threshold, ["a", "b", "similarity"]]

    return run


def distinct_texts(records: DataFrame, id_column: str, head: str | None, body: str) -> DataFrame:
    """Records as (id, key, head, body), key being a 64-bit fingerprint of the texts; exact copies share it."""
    h = F.col(head) if head else F.lit(None).cast("string")
    mark = F.when(h.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), h))
    return records.where(F.col(id_column).isNotNull() & F.col(body).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(mark, F.col(body)).alias("key"), h.alias("head"), F.col(body).alias("body"))


#: Columns of once_each(); every reader takes them all, so that one shuffle of the texts serves all readers.
ONCE = ["key", "head", "body", "lo", "hi"]


def once_each(texts: DataFrame, min_words: int) -> DataFrame:
    """Each different text once with its least and greatest id; copies collapse before the shuffle. Too short texts drop out."""
    return texts.where(F.length("body") >= max(1, 2 * min_words - 1)).groupBy("key").agg(F.first("head").alias("head"), F.first("body").alias("body"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _copied(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[len(words_of(x)) >= min_words for x in f["body"]], ["key"]]

    return run


def similar_texts(
    texts: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 8, min_words: int = 1, bits: int | None = None
) -> DataFrame:
    """Pairs (a, b, similarity) of different texts, a < b by key, whose word-run sets have Jaccard similarity >= threshold.

    texts: as from distinct_texts(). Copies collapse to one text before anything else, pre-aggregated on the map
    side, so a text that makes up a third of all rows is sketched and compared once. Texts meet where a band of
    their SuperMinHash signatures is equal; the join drops a pair at once unless a 128-bit sketch of the same
    signatures agrees in at least `bits` places (default: 2.4 standard deviations below what the threshold gives),
    so a band that many texts share costs comparisons of two longs and no rows; the join is a sort-merge join
    that the planner splits where a band is skewed. Pairs that remain are checked on their whole texts. No
    bucket is capped. A pair at similarity s is met with probability 1 - (1 - s^rows)^bands, and passes the
    sketch with 0.99 at the threshold and nearly 1 above; tests/llm/recall.py counts what is found.
    """
    expected = 128 * (1 + threshold) / 2
    spread = (expected * (1 - (1 + threshold) / 2)) ** 0.5
    bits = int(expected - 2.4 * spread) if bits is None else bits
    once = once_each(texts, min_words)
    marks = once.select(*ONCE).mapInPandas(_sketcher(width, bands, rows, min_words), "band long, key long, s1 long, s2 long")
    x, y = marks.alias("x"), marks.alias("y")
    agree = F.lit(128) - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) - F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    met = x.join(y.hint("merge"), F.col("x.band") == F.col("y.band")).where((F.col("x.key") < F.col("y.key")) & (agree >= bits))
    pairs = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    left = once.select(F.col("key").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ONCE[1:]])
    right = once.select(F.col("key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ONCE[1:]])
    full = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return full.mapInPandas(_verifier(width, threshold), "a long, b long, similarity double")


def near_duplicate_pairs(records: DataFrame, id_column: str = "id", head: str | None = "title", body: str = "description", min_words: int = 30, **how) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of records whose texts are alike or equal.

    Every pair is a row, those of copies too: use near_duplicate_groups() where copies may be many. Records
    without id or body, or with fewer than min_words words in the body, are in no pair; rows delivered twice
    count once; empty tables give no rows; further columns don't matter.
    """
    texts = distinct_texts(records, id_column, head, body)
    members = texts.select("key", "id").distinct()
    found = similar_texts(texts, min_words=min_words, **how)
    ka, kb = members.select(F.col("key").alias("a"), F.col("id").alias("ia")), members.select(F.col("key").alias("b"), F.col("id").alias("ib"))
    across = found.join(ka, "a").join(kb, "b").select("ia", "ib")
    copied = once_each(texts, min_words).where("lo < hi").select(*ONCE).mapInPandas(_copied(min_words), "key long")
    again = members.join(copied, "key", "left_semi")
    equal = again.alias("p").join(again.alias("q"), "key").where("p.id < q.id").select(F.col("p.id").alias("ia"), F.col("q.id").alias("ib"))
    return across.union(equal).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def near_duplicate_groups(records: DataFrame, id_column: str = "id", head: str | None = "title", body: str = "description", min_words: int = 30, **how) -> DataFrame:
    """One row per record with a body: (id, class_id, text_links, copies).

    class_id is the smallest id among the records tied by chains of near-duplicate texts, text_links the number
    of different texts alike to the record's own, copies the number of records with exactly its text. Copies
    are never expanded into pairs. Other cases as in near_duplicate_pairs().
    """
    texts = distinct_texts(records, id_column, head, body)
    ensure_checkpoint_dir(records.sparkSession)
    found = similar_texts(texts, min_words=min_words, **how).select("a", "b").checkpoint()
    parts = components(found)
    links = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("text_links"))
    per_text = texts.select("key", "id").groupBy("key").agg(F.min("id").alias("least"), F.count_distinct("id").alias("copies"))
    per_text = per_text.join(links, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    per_text = per_text.select("key", "least", "copies", F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("component", "key").alias("component"))
    classes = per_text.groupBy("component").agg(F.min("least").alias("class_id"))
    named = per_text.join(classes, "component").select("key", "class_id", "text_links", "copies")
    return texts.select("key", "id").distinct().join(named, "key").select("id", "class_id", "text_links", "copies")

