"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct word n-grams (64-bit fingerprints of the
words). Documents with equal sets become one, its representative. Two sets link
if 100 * intersection >= percent * union, so each holds at least the share
percent/100 of the other's elements, and of its own.

1. Document frequencies of all n-grams, asked by block (blocks.py). A set with
   too few n-grams that another set also has can have no link and is done with.
2. The others put their n-grams in order of frequency; any two that link share
   one of the first size - T + 1, where T is the least overlap. Sharing one of
   those gives families, by stars around the least member of each posting list:
   no pairs are listed. A link never leaves its family.
3. T-occurrence search in families, with an inverted index of each part: short
   lists are merged in order, long ones are probed by binary search for what reached the
   threshold so far, and exact overlaps decide. Two members that are known to be
   connected are not compared again. A family of more than `part` members, or
   of more than `part_tokens` n-grams, is searched in parts: each in itself, then
   all against the first; after that nearly all of a dense family is one
   component. Members outside of the largest component go on to those parts
   that hold one of the n-grams of step 2. Every pair of members in different
   components that could link has then been looked at, so no link between
   components is lost, and neither a dense family nor one that a common phrase
   holds together costs its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .blocks import ROW_BITS, Blocks, first_of, planes, split_ranges, unplanes
from .common import partitions, stage, table, unstage
from .embedding_dedup import _Forest
from .graph import components
from .words import U64, give_back, mix, ngrams, words_of

ROW_MASK = (1 << ROW_BITS) - 1


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and fingerprint of every element of each text's set, in order of both."""
    w = words_of(texts, fold=True)
    first, h = ngrams(w, n)
    doc = w.doc[first]
    counts = np.diff(w.bounds())
    for size in range(1, n):  # a short text is one element, its whole word sequence
        docs = np.flatnonzero(counts == size)
        if len(docs):
            at = w.bounds()[docs]
            acc = np.full(len(docs), U64(size))
            for k in range(size):
                acc = mix(acc * U64(0x9FB21C651E98DF25) + w.hash[at + k])
            doc, h = np.r_[doc, docs], np.r_[h, acc]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = first_of(doc) | first_of(h)
    return doc[keep], h[keep]


def least_overlap(size, percent: int):
    """The least intersection of a set of this size with one that it links with."""
    return -(-size * percent // 100)


def t_occurrence(threshold: int, lists: list[np.ndarray], mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Index members that occur in at least threshold of the lists, and in how many; each list is sorted."""
    if len(lists) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = sorted(lists, key=len, reverse=True)
    n_long = min(threshold - 1, int(threshold / (mu * np.log2(max(2, len(lists[0]))) + 1)), len(lists) - 1)
    merged = np.sort(np.concatenate(lists[n_long:]), kind="stable")  # merges the sorted lists run by run
    start = np.flatnonzero(first_of(merged))
    count = np.diff(np.r_[start, len(merged)])
    found, count = merged[start][count >= threshold - n_long], count[count >= threshold - n_long]
    for k, long in enumerate(lists[:n_long]):
        at = np.minimum(np.searchsorted(long, found), len(long) - 1)
        count = count + (long[at] == found)
        keep = count >= threshold - (n_long - 1 - k)
        found, count = found[keep], count[keep]
        if not len(found):
            break
    return found, count


def search(queries: list[np.ndarray], index: list[np.ndarray], percent: int, forest: _Forest, query_names: list[int], index_names: list[int], itself: bool) -> None:
    """Joins in the forest what links between queries and index; members that it connects already are not compared."""
    if not index or not queries:
        return
    owner = np.repeat(np.arange(len(index)), [len(x) for x in index])
    token = np.concatenate(index)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    start = np.flatnonzero(first_of(token))
    vocabulary, ends = token[start], np.r_[start[1:], len(token)]
    sizes = np.array([len(x) for x in index])
    roots = np.array([forest.root(x) for x in index_names])
    for q, (query, name) in enumerate(zip(queries, query_names, strict=True)):
        root = forest.root(name)
        if (roots == root).all():
            continue
        at = np.searchsorted(vocabulary, query)
        at = at[at < len(vocabulary)]
        hit = at[vocabulary[at] == query[: len(at)]] if len(at) == len(query) else np.flatnonzero(np.isin(vocabulary, query))
        threshold = int(least_overlap(len(query), percent))
        found, count = t_occurrence(threshold, [owner[start[k] : ends[k]] for k in hit])
        if itself:
            found, count = found[found < q], count[found < q]
        good = found[100 * count >= percent * (len(query) + sizes[found] - count)]
        for k in good:
            forest.join(name, index_names[k])
        if len(good):
            old = np.unique(np.r_[roots[good], root])
            new = forest.root(name)
            roots[np.isin(roots, old)] = new


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(x, np.uint64)) for x in column.to_pylist()]


def _links(found: list[tuple[int, int]]) -> pa.Table:
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, part: int = 512, part_tokens: int = 1 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    A-Z are lower-cased; a text of fewer than n words has its whole word
    sequence as its one element; a null text, or one without words, has an empty
    set and links with nothing. Rows that repeat an id are documents of their
    own under one id. A row with a null id is counted but not linked; its
    component is null. Other columns are ignored; an empty table gives an empty
    result. Ids are longs.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    blocks = Blocks.of(docs, id_col, text_col, block_bytes)
    ranges = partitions(spark)

    def summarise(row: dict) -> Iterator[pa.RecordBatch]:
        doc, h = shingle_sets(row["texts"], n)
        size = np.bincount(doc, minlength=len(row["ids"]))
        start = np.cumsum(size) - size
        a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        some = size > 0
        if len(h):
            a[some] = np.add.reduceat(mix(h + U64(1)), start[some])
            b[some] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), start[some])
        rows = (row["block"] << ROW_BITS) + np.arange(len(size))
        yield pa.RecordBatch.from_arrays([pa.array(rows), row["ids"], pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["row", "id", "n", "f1", "f2"])

    every = stage(blocks.run(summarise, "row long, id long, n long, f1 long, f2 long"), "sets")
    linkable = every.where("n > 0 and id is not null")
    reps = stage(linkable.groupBy("f1", "f2", "n").agg(F.min("row").alias("rep"), F.min("id").alias("least_id")), "representatives")
    chosen = reps.select(F.shiftright("rep", ROW_BITS).alias("block"), F.col("rep").bitwiseAND(ROW_MASK).cast("int").alias("place"))

    def members(row: dict) -> tuple[np.ndarray, np.ndarray]:
        places = np.array(sorted(x["place"] for x in row["chosen"]), np.int64)
        doc, h = shingle_sets(row["texts"].take(pa.array(places)), n)
        return places[doc] if len(doc) else doc, h

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        if not row["chosen"]:
            return
        h, count = np.unique(members(row)[1], return_counts=True)
        at = split_ranges(h, ranges)
        full = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(np.full(len(full), row["block"], np.int64)),
                pa.array([planes(h[at[k] : at[k + 1]]) for k in full], pa.binary()),
                pa.array([planes(count[at[k] : at[k + 1]].astype(np.uint32)) for k in full], pa.binary()),
            ],
            names=["range", "block", "hashes", "counts"],
        )

    def answer(group: pa.Table) -> pa.Table:
        hashes = [unplanes(x, np.uint64) for x in group.column("hashes").to_pylist()]
        counts = np.concatenate([unplanes(x, np.uint32) for x in group.column("counts").to_pylist()]).astype(np.int64)
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        start = np.flatnonzero(first_of(flat[order]))
        df = np.add.reduceat(counts[order], start)
        code = np.where(df < 128, df, 120 + np.log2(df)).astype(np.uint8)  # in order of frequency
        back = np.empty(len(flat), np.uint8)
        back[order] = np.repeat(code, np.diff(np.r_[start, len(flat)]))
        cuts = np.cumsum([len(x) for x in hashes])[:-1]
        out = pa.table({"block": group.column("block"), "range": group.column("range"), "codes": pa.array([x.tobytes() for x in np.split(back, cuts)], pa.binary())})
        del hashes, counts, flat, order, start, df, code, back
        give_back()
        return out

    asked = blocks.run(ask, "range int, block long, hashes binary, counts binary", chosen=chosen)
    answers = stage(asked.groupBy("range").applyInArrow(answer, "block long, range int, codes binary"), "frequencies")

    def survive(row: dict) -> Iterator[pa.RecordBatch]:
        if not row["chosen"]:
            return
        doc, h = members(row)
        codes = np.frombuffer(b"".join(x["codes"] for x in sorted(row["answers"], key=lambda x: x["range"])), np.uint8)
        code = codes[np.searchsorted(np.unique(h), h)]
        start = np.flatnonzero(first_of(doc))
        size = np.diff(np.r_[start, len(doc)])
        shared = np.add.reduceat((code > 1).astype(np.int64), start) if len(doc) else size
        out: dict[str, list] = {"rep": [], "size": [], "tokens": [], "prefix": []}
        for k in np.flatnonzero(shared >= least_overlap(size, percent)):
            a, b = start[k], start[k] + size[k]
            order = np.lexsort((h[a:b], code[a:b]))
            lead = order[: size[k] - least_overlap(int(size[k]), percent) + 1]
            out["rep"].append((row["block"] << ROW_BITS) + int(doc[a]))
            out["size"].append(int(size[k]))
            out["tokens"].append(h[a:b].tobytes())
            out["prefix"].append(h[a:b][lead][code[a:b][lead] > 1].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(out["rep"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["tokens"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))], names=list(out))

    alive = stage(blocks.run(survive, "rep long, size long, tokens binary, prefix array<long>", chosen=chosen, answers=answers), "survivors")
    blocks.drop()
    unstage(answers)

    postings = alive.select("rep", F.explode("prefix").alias("token"))
    heads = stage(postings.groupBy("token").agg(F.min("rep").alias("head"), F.count("*").alias("df")).where("df > 1").select("token", "head"), "heads")
    family = components(postings.join(heads, "token").where("head <> rep").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    family = stage(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    parts = F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("size") / part_tokens)).cast("int")
    sizes = stage(family.join(alive.select("rep", "size"), "rep").groupBy("family").agg(parts.alias("parts")), "family-sizes")
    placed = family.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = stage(alive.select("rep", "size", "tokens").join(placed.select("rep", "family", "part", "parts"), "rep"), "members")

    def inside(group: pa.Table) -> pa.Table:
        names, sets, forest = group.column("rep").to_pylist(), _sets(group.column("tokens")), _Forest()
        search(sets, sets, percent, forest, names, names, True)
        return _links([(x, r) for x in names if (r := forest.root(x)) != x])

    found = stage(placed.groupBy("family", "part").applyInArrow(inside, "a long, b long"), "links")
    wide = placed.where("parts > 1")
    if wide.limit(1).count():
        found = _across(wide.drop("parts"), postings, found, percent, part, part_tokens)

    label = components(found).withColumnRenamed("node", "rep")
    named = reps.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = stage(named.join(least, "component").select("f1", "f2", "n", "component_id"), "set-facts")
    unstage(alive, placed)
    joined = every.join(facts.where("n > 0"), ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _across(wide: DataFrame, postings: DataFrame, found: DataFrame, percent: int, part: int, part_tokens: int) -> DataFrame:
    """found with the links between the parts of families that have several. postings: rep, token of all prefixes."""

    def label(links: DataFrame) -> DataFrame:
        return stage(wide.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")

    def cross(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        names, comp = group.column("rep").to_pylist(), group.column("component").to_pylist()
        sets = _sets(group.column("tokens"))
        forest = _Forest()
        for x, c in zip(names, comp, strict=True):
            forest.join(x, c)
        pick = lambda xs, side: [x for x, s in zip(xs, asks, strict=True) if s == side]
        search(pick(sets, True), pick(sets, False), percent, forest, pick(names, True), pick(names, False), False)
        return _links([(c, r) for c in sorted(set(comp)) if (r := forest.root(c)) != c])

    def searched(asking: DataFrame, tasks: DataFrame, labelled: DataFrame) -> DataFrame:
        """asking: members with the part that they ask and a chunk; each chunk against that part of its family. tasks: what asks what."""
        columns = ["family", "chunk", "target", "asks", "rep", "tokens", "component"]
        mine = asking.withColumn("asks", F.lit(True)).select(columns)
        theirs = labelled.withColumnRenamed("part", "target").join(tasks, ["family", "target"]).withColumn("asks", F.lit(False)).select(columns)
        return mine.union(theirs).groupBy("family", "chunk", "target").applyInArrow(cross, "a long, b long")

    once = label(found)
    asking = once.where("part > 0").withColumn("target", F.lit(0)).withColumnRenamed("part", "chunk")
    first = searched(asking, asking.select("family", "target", "chunk").distinct(), once)
    both = stage(found.union(first), "links")
    twice = label(both)
    main = twice.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    outside = stage(twice.join(stage(main, "main"), "family").where("component <> main").drop("main", "part"), "outside")
    # A member asks the parts that hold a token of its prefix, not all: any two that link share one.
    spots = wide.select("rep", "family", "part").join(postings, "rep").select("family", "token", F.col("part").alias("target")).distinct()
    asked = outside.select("rep", "family", "size").join(postings, "rep").join(spots, ["family", "token"]).select("rep", "family", "target", "size").distinct()
    asked = stage(asked, "asked")
    chunks = F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("size") / part_tokens)).alias("chunks")
    loads = asked.groupBy("family", "target").agg(chunks)
    chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int")
    placed = stage(asked.drop("size").join(loads, ["family", "target"]).withColumn("chunk", chunk).drop("chunks"), "chunks")
    second = searched(outside.join(placed, ["rep", "family"]), placed.select("family", "target", "chunk").distinct(), twice)
    return stage(both.union(second), "links")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_documents of all documents by five-word shingles at 80 percent; null texts have empty sets."""
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
