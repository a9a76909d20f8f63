"""Lines repeated across one source's documents: weighted line graph, high-support nodes and edges, blocks, removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.session import ensure_checkpoint_dir

_ID, _SOURCE, _TEXT = "id", "source_id", "description"
#: Up to so many kept lines (some 8 MB) they are broadcast; more are joined by shuffling.
BROADCAST_LINES = 200_000


def _keys(text: Column) -> Column:
    """Fingerprints of each line's lower-case letters; lines without letters share that of the empty text."""
    return F.transform(F.split(text, "\n"), lambda line: F.xxhash64(F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")))


def _no_letters() -> Column:
    return F.xxhash64(F.lit(""))


def keyed_documents(documents: DataFrame, id_column: str = _ID, source: str = _SOURCE, text: str = _TEXT) -> DataFrame:
    """(id, source, keys) of each document with an id, checkpointed: keys[k] stands for line k + 1, null without text.

    Line fingerprints are made where the text lies, so all later steps move eight bytes a line. Of rows with the
    same id the one whose source and text have the least fingerprint counts.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.struct(F.xxhash64(source, text).alias("h"), F.col(source).alias("source"), _keys(F.col(text)).alias("keys")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.source", "row.keys").checkpoint()


def repeated_lines(keyed: DataFrame, least: int = 5, share: float = 0.03) -> DataFrame:
    """High-support nodes of the line graph: (source, line_key, support, total).

    support is the number of documents of the source with such a line, total all its documents, those without
    text too; a node is kept with support >= least and >= share * total. Documents are rows already, so counts
    are plain sums, pre-aggregated before their shuffle: a source or a line that a third of all rows hold is
    spread over its documents. A source has at most 1/share kept lines for every line of its average document.
    """
    known = keyed.where("source is not null")
    total = known.groupBy("source").agg(F.count("*").alias("total"))
    said = known.select("source", F.explode(F.array_distinct("keys")).alias("line_key")).where(F.col("line_key") != _no_letters())
    support = said.groupBy("source", "line_key").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    return support.join(total, "source").where(F.col("support") >= F.lit(share) * F.col("total"))


def _by_source(lines: DataFrame, count: int, *more: Column) -> DataFrame:
    """The kept lines of each source in one row; a source's are bounded by repeated_lines()."""
    packed = lines.groupBy("source").agg(F.collect_list("line_key").alias("kept"), *more)
    return F.broadcast(packed) if count <= BROADCAST_LINES else packed


def line_edges(keyed: DataFrame, nodes: DataFrame, count: int, least: int, share: float) -> DataFrame:
    """High-support edges (source, a, b, edge_support): kept lines that follow one another, lines without letters aside.

    Neighbours are paired inside the document's row and only pairs of kept lines leave it.
    """
    known = keyed.where("source is not null and size(keys) > 1").join(_by_source(nodes, count, F.first("total").alias("total")), "source")
    own = F.array_intersect("keys", "kept")
    lettered = known.select("source", "total", own.alias("own"), F.filter("keys", lambda k: k != _no_letters()).alias("ls")).where("size(own) > 1")
    pairs = F.zip_with(F.slice("ls", F.lit(1), F.size("ls") - 1), F.slice("ls", F.lit(2), F.size("ls") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.filter(pairs, lambda p: (p["a"] != p["b"]) & F.array_contains("own", p["a"]) & F.array_contains("own", p["b"]))
    counted = lettered.select("source", "total", F.explode(F.array_distinct(kept)).alias("e")).groupBy("source", "total", "e.a", "e.b").agg(F.count("*").alias("edge_support"))
    return counted.where((F.col("edge_support") >= least) & (F.col("edge_support") >= F.lit(share) * F.col("total"))).select(F.col("source").alias("source"), "a", "b", "edge_support")


def _blocks_of_source(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one source's kept graph by union-find."""
    parent = {k: k for k in nodes["line_key"].tolist()}
    best: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, n in zip(edges["a"].tolist(), edges["b"].tolist(), edges["edge_support"].tolist()):
        best[a], best[b] = max(n, best.get(a, 0)), max(n, best.get(b, 0))
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    lines = nodes["line_key"].tolist()
    return pd.DataFrame({"source": nodes["source"], "block": [root(k) for k in lines], "line_key": lines, "support": nodes["support"], "edge_support": pd.Series([best.get(k) for k in lines], dtype="Int64", index=nodes.index)})


def _blocks(keyed: DataFrame, least: int, share: float) -> tuple[DataFrame, int]:
    nodes = repeated_lines(keyed, least, share).checkpoint()
    count = nodes.count()
    edges = line_edges(keyed, nodes, count, least, share)
    kind = nodes.schema["source"].dataType.simpleString()
    blocks = nodes.groupBy("source").cogroup(edges.groupBy("source")).applyInPandas(_blocks_of_source, f"source {kind}, block long, line_key long, support long, edge_support long")
    return blocks, count


def boilerplate_blocks(documents: DataFrame, least: int = 5, share: float = 0.03, id_column: str = _ID, source: str = _SOURCE, text: str = _TEXT) -> DataFrame:
    """Blocks of boilerplate: (source, block, line_key, support, edge_support).

    An edge joins two kept lines that follow one another in at least `least` documents and in `share` of the
    source's; connected components of the kept graph are blocks, a line without such an edge is a block of its
    own. block is the smallest node of the component, edge_support the strongest edge at the line (null without
    one). A component never leaves its source, whose kept lines are bounded (see repeated_lines()), so one task
    joins a source's graph.
    """
    return _blocks(keyed_documents(documents, id_column, source, text), least, share)[0]


def boilerplate_lines(documents: DataFrame, least: int = 5, share: float = 0.03, id_column: str = _ID, source: str = _SOURCE, text: str = _TEXT) -> DataFrame:
    """Occurrences (id, line_no) of the lines of boilerplate blocks.

    Null ids, texts or sources and lines without letters are no case; a document delivered twice counts once;
    empty tables give no rows; further columns are ignored. A source's blocks come to its documents' rows and
    the occurrences are read off in place.
    """
    keyed = keyed_documents(documents, id_column, source, text)
    blocks, count = _blocks(keyed, least, share)
    rows = keyed.where("keys is not null").join(_by_source(blocks, count), "source").select("id", "keys", F.array_intersect("keys", "kept").alias("own")).where("size(own) > 0")
    at = F.filter(F.transform("keys", lambda k, i: F.when(F.array_contains("own", k), i + 1)), lambda n: n.isNotNull())
    return rows.select("id", F.explode(at).alias("line_no"))


def without_boilerplate(documents: DataFrame, least: int = 5, share: float = 0.03, id_column: str = _ID, source: str = _SOURCE, text: str = _TEXT) -> DataFrame:
    """Each document once, (id, source, text without the lines of its source's blocks, removed_lines); all other lines keep their order and ends.

    The blocks come to the texts, which are filtered in place and shuffled once, to drop rows delivered twice.
    Documents without text keep null.
    """
    blocks, count = _blocks(keyed_documents(documents, id_column, source, text), least, share)
    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(source, text).alias("h"), _keys(F.col(text)).alias("keys"))
    marked = rows.join(_by_source(blocks, count), "source", "left").select("id", "h", "source", "text", "keys", F.array_intersect("keys", "kept").alias("own"))
    gone = F.size(F.filter("keys", lambda k: F.array_contains("own", k)))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("own", F.get("keys", i))), "\n")
    cut = marked.select("id", F.struct("h", "source", F.when(F.size("own") > 0, kept).otherwise(F.col("text")).alias("text"), F.when(F.size("own") > 0, gone).otherwise(0).alias("removed_lines")).alias("row"))
    return cut.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.source", "row.text", "row.removed_lines")
