"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct 5-word shingles (64-bit hashes of the words, ASCII lower
case, joined by single blanks). Equal sets form a class, and one row of each class goes on.

1. *Order.* A first pass counts, over all documents, how many hold a shingle of each hash range; there are as many
   ranges as documents, ``2**ORDER_BITS`` at least and ``2**MOST_ORDER_BITS`` at most. Shingles are ordered by
   that count, then by hash: one total order for every document, the shingles of frequent passages last.
2. *Prefix.* Sets that reach ``percent`` share one of their first ``n - ceil(n * percent / 100)
   + 1`` shingles. Only these are joined; one that a single class holds drops out at once (those of ranges that many
   documents hold are kept unseen, so no large group is brought together for this).
3. *Candidates.* In each prefix shingle's bucket, rows of a size band are paired with one pivot
   row, not with each other; classes found linked become one component. Rounds with new pivots
   go on while they pay, over the buckets that still hold several components; then every pair of the bucket *whose components differ* is taken, so no link
   between components is lost and none inside a component is listed. Pairs must pass the length
   filter (sizes) and, at their first common shingle, the positional filter.
4. *Verification, once per pair.* The suffix filter bounds the overlap by the counts of both
   sets in equal hash ranges, about four hashes each; pairs that pass are compared exactly,
   ``100 * intersection >= percent * union``.

Results are exact but for collisions of 64-bit hashes. Defined results: a document without text
or words has an empty set, is linked with nothing and is its own component; rows that repeat an
id are documents of their own that carry the same id; a null id is never a component's id unless
all its members have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabsight.llm.common import give_back, ship, stored
from tabsight.llm.components import components

ORDER_BITS, MOST_ORDER_BITS = 18, 22
KEYS_A_ROW = 512  # keys that one route names; more go in rows of their own
MAX_BIN_BITS = 14  # ranges of a set's suffix filter: 2**this at most
BROADCAST_IDS = 1_000_000  # ids in a broadcast semi-join; beyond it Spark shuffles
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that nearby sums spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as longer texts come."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def hashed_windows(words: list[bytes], width: int) -> np.ndarray:
    """The 64-bit hash of every ``width`` consecutive words, in order (all words, if fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * _powers(_ODD, len(raw)), out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    k = min(width, len(words))
    starts, ends = starts[:len(starts) - k + 1], ends[k - 1:]
    return _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a whole text."""
    return np.unique(hashed_windows((text or "").encode().lower().split(), width))  # bytes: A-Z, and blanks 09-0D and 20


def _signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _ranges(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, kind)))


def bucket_counts(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents hold a shingle of each hash range, of 2**ORDER_BITS to 2**MOST_ORDER_BITS."""
    bits = min(MOST_ORDER_BITS, max(ORDER_BITS, docs.count().bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(total, _ranges(shingles(value.as_py(), width), bits), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["range", "n"])
        give_back()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the driver gets two byte strings a batch, not an object a range
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("range").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                 pa.array([batch.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary())], names=["ranges", "ns"])

    counted = docs.select(F.col(text)).mapInArrow(count, "range long, n long").groupBy("range").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << bits, np.int64)
    for r in counted.mapInArrow(pack, "ranges binary, ns binary").collect():  # at most 12 bytes * 2**MOST_ORDER_BITS
        out[np.frombuffer(r["ranges"], np.int32)] = np.frombuffer(r["ns"], np.int64)
    return out


def prefixes(docs: DataFrame, percent: int, id_column: str, text: str, width: int) -> DataFrame:
    """(``row``, ``id``, ``n``, ``sig``, ``prefix``, ``light``, ``bins``) per row of ``docs``, written once; ``light``
    shingles of the prefix, its first, lie in ranges of at most twice the mean count; ``bins`` counts the set's hashes
    in equal ranges, about four hashes a range."""
    counts = bucket_counts(docs, text, width)
    order_bits, usual = len(counts).bit_length() - 1, 2 * counts.mean()
    order = docs.sparkSession.sparkContext.broadcast(counts)
    del counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures, heads, light, bins = [], [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), width)
                n = len(found)
                keep = n + (-percent * n // 100) + 1 if n else 0  # n - ceil(percent * n / 100) + 1
                held_by = order.value[_ranges(found, order_bits)]
                rank = np.lexsort((found, held_by))[:keep]
                light.append(int((held_by[rank] <= usual).sum()))
                sizes.append(n)
                signatures.append(_signature(found))
                heads.append(found[rank].view(np.int64))
                bits = min(MAX_BIN_BITS, max(1, (n // 4).bit_length()))
                bins.append(np.bincount(_ranges(found, bits), minlength=1 << bits).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary()),
                 _lists(heads, np.int64), pa.array(light, pa.int32()), _lists(bins, np.int32)],
                names=["row", "id", "n", "sig", "prefix", "light", "bins"])
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = stored(rows.mapInArrow(run, f"row long, id {id_type}, n int, sig binary, prefix array<long>, light int, bins array<int>"), "prefixes")
    order.unpersist()
    return out


def _sets(docs: DataFrame, routes: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """(``key``, ``cid``, ``set``) for the rows of ``routes`` (key, cid, id, sig, many): the set of
    class ``cid``, made from the text of a document of that class and sent to ``key``, once. Where several rows
    have the class's id and set (``many``), one of them is kept before the sets are joined."""
    found = _made(docs, routes.where("NOT many"), id_column, text, width)
    repeated = routes.where("many")
    if repeated.isEmpty():
        return found
    return found.union(_made(docs, repeated, id_column, text, width).dropDuplicates(["cid", "key"]))


def _made(docs: DataFrame, routes: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    of_class = routes.groupBy("cid").agg(F.count("*").alias("n_keys"))
    crowded = of_class.where(F.col("n_keys") > KEYS_A_ROW).withColumn("parts", F.ceil(F.col("n_keys") / KEYS_A_ROW))
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    ways = routes.join(crowded.select("cid", "parts"), "cid", "left").groupBy(
        "cid", F.col("id").alias("way_id"), "sig", part.alias("part")).agg(F.collect_set("key").alias("keys"))
    if routes.count() <= BROADCAST_IDS:  # a route is a key of 8 bytes, and at most an id and a signature
        ways = F.broadcast(ways)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = rows.join(ways, rows["id"].eqNullSafe(ways["way_id"])).select("text", "sig", "cid", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (value, sig) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                found = shingles(value.as_py(), width)
                if _signature(found) != sig.as_py():  # another document with this id
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(k, 1), batch.column(3).slice(k, 1),
                     pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["cid", "keys", "set"])

    found = rows.mapInArrow(run, "cid long, keys array<long>, set array<long>")
    return found.select("cid", "set", F.explode("keys").alias("key"))


def _needed(percent: int, a: str, b: str) -> str:
    """The least overlap of sets of sizes a and b that reaches the threshold."""
    return f"ceil({percent}L * ({a} + {b}) / {100 + percent}D - 1e-9D)"


def _suffix_filtered(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those whose sets cannot share enough: what two sets share in a hash range is at
    most the smaller of their counts there. Sizes within the length filter differ by one halving at most."""
    ends = stored(pairs.select(F.col("x").alias("row")).union(pairs.select(F.col("y"))).distinct(), "ends")
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)
    bins = stored(rows.select("row", "bins").join(ends, "row"), "bins")
    both = (pairs.join(bins.withColumnsRenamed({"row": "x", "bins": "bx"}), "x")
            .join(bins.withColumnsRenamed({"row": "y", "bins": "by"}), "y"))
    halved = "transform(sequence(0, size({0}) div 2 - 1), i -> {0}[2 * i] + {0}[2 * i + 1])"
    both = both.withColumns({"hx": F.expr(f"CASE WHEN size(bx) > size(by) THEN {halved.format('bx')} ELSE bx END"),
                             "hy": F.expr(f"CASE WHEN size(by) > size(bx) THEN {halved.format('by')} ELSE by END")})
    most = F.expr("aggregate(zip_with(hx, hy, (a, b) -> least(a, b)), 0, (t, a) -> t + a)")
    return both.where(most >= F.expr(_needed(percent, "nx", "ny"))).select("x", "y", "nx", "ny")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, docs: DataFrame, percent: int,
              id_column: str, text: str, width: int) -> DataFrame:
    """The (``u``, ``v``) of ``pairs`` (x, y, nx, ny) whose sets reach the threshold. The set of x is
    sent to y once for the pair; sets are made anew from the texts, none are kept."""
    pairs = stored(_suffix_filtered(stored(pairs, "candidates"), rows, percent), "pairs")
    named = classes.select("cid", "id", "sig", "n", "many")
    xs = pairs.select(F.col("x").alias("cid"), F.col("y").alias("key")).join(named, "cid")
    ys = pairs.select(F.col("y").alias("cid"), F.col("y").alias("key")).distinct().join(named, "cid")
    left = _sets(docs, xs, id_column, text, width).select(
        "key", F.col("cid").alias("x"), F.col("set").alias("sx"))
    right = _sets(docs, ys, id_column, text, width).select(
        "key", F.col("set").alias("sy"))
    both = left.join(right, "key").withColumns({"nx": F.size("sx"), "ny": F.size("sy")})
    shared = F.size(F.array_intersect("sx", "sy"))
    return (both
            .where(100 * shared >= percent * (F.col("nx") + F.col("ny") - shared))
            .select(F.col("x").alias("u"), F.col("key").alias("v")))


def _candidates(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y, nx, ny, common) that pass the positional filter: sets that reach the
    threshold have enough shingles left, in both, from their first common one on. A pair that has such
    a shingle keeps it here; its other common ones may go."""
    near = joined.where(f"least(nx - ix, ny - iy) >= {_needed(percent, 'nx', 'ny')}")
    return near.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.count("*").alias("common"))


def link_classes(docs: DataFrame, rows: DataFrame, percent: int, id_column: str, text: str, width: int) -> DataFrame:
    """(``sig``, ``id``, ``n``, ``many``, ``cid``, ``component``) per class of equal sets; ``id`` is its smallest and
    ``many`` tells whether several of its rows have that id."""
    alike = rows.where("n > 0").groupBy("sig", "id").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.count("*").alias("c"))
    classes = alike.groupBy("sig").agg(F.min("row").alias("cid"), F.first("n").alias("n"),
                                       F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("c").alias("c"))).alias("least"))
    classes = stored(classes.select("sig", "least.id", "n", "cid", (F.col("least.c") > 1).alias("many")), "classes")
    copies = rows.where("n > 0").select("row").join(classes.select(F.col("cid").alias("row")), "row", "left_anti")
    copies = stored(copies, "copies")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    every = (rows.where("n > 0").join(copies, "row", "left_anti")
             .select(F.col("row").alias("cid"), "n", "light", F.posexplode("prefix").alias("i", "token")))
    at = Window.partitionBy("token")  # at most twice the mean count of a range
    shared = (every.where("i < light").select("cid", "n", "i", "token", (F.min("cid").over(at) < F.max("cid").over(at)).alias("several"))
              .where("several").drop("several"))
    tokens = stored(shared.union(every.where("i >= light").select("cid", "n", "i", "token"))
                    .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")),
                    "buckets")

    links, labels, best, turn, size = None, None, None, 0, tokens.count()
    while True:
        labelled = tokens.withColumns({"component": F.col("cid"), "weight": F.lit(1).cast("long")})
        if labels is None:  # every class is a component
            k = F.col("s")
            held, mixed = None, tokens.groupBy("token").agg(F.count("*").cast("double").alias("s")).withColumns({"c": k, "q": k})
        else:
            weighed = labels.join(labels.groupBy("component").agg(F.count("*").alias("weight")), "component")
            labelled = stored(tokens.join(weighed.withColumnRenamed("node", "cid"), "cid", "left").withColumns(
                {"component": F.coalesce("component", "cid"), "weight": F.coalesce("weight", F.lit(1))}), "labelled")
            # what a full comparison of differing components would list
            held = stored(labelled.groupBy("token", "component").agg(
                F.count("*").cast("double").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"),
                F.max(F.col("n") - F.col("i")).alias("left")), "held")
            mixed = held.groupBy("token").agg(F.count("*").alias("c"), F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        mixed = stored(mixed.where("c > 1"), "mixed")
        if labels is not None:  # buckets of one component are done
            labelled = stored(labelled.join(mixed.select("token"), "token", "left_semi"), "open")
            tokens = labelled.select(*tokens.columns)
        todo = mixed.agg(F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).first()[0]
        if not todo:
            break
        full = turn > 0 and (todo <= 4 * size or todo > 0.9 * best)
        best = todo
        if full:
            pairs = _candidates(_across(labelled, held, mixed, percent), percent)
        else:
            # the pivot of a bucket: of its largest component, the class with the fewest shingles before this one
            # (the likeliest to pass the positional filter); classes outside that component are compared with it
            pivot = labelled.groupBy("token", "band").agg(F.min(F.struct(
                (-F.col("weight")).alias("w"), F.col("i").alias("iy"), F.xxhash64("cid", F.lit(turn)).alias("h"),
                F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))).alias("p"))
            pivot = pivot.select("token", "band", "p.cy", "p.y", "p.ny", "p.iy")
            pairs = _candidates(
                labelled.join(pivot, ["token", "band"]).where("component <> cy")
                .select(F.col("cid").alias("x"), "y", F.col("n").alias("nx"), "ny", F.col("i").alias("ix"), "iy"), percent)
            # of a class's pivots, the one with the most prefix shingles in common; later rounds try others
            pairs = pairs.groupBy("x").agg(F.max(F.struct("common", "y", "nx", "ny")).alias("p")).select("x", "p.*")
        new = _verified(pairs, rows, classes, docs, percent, id_column, text, width)
        links = stored(new if links is None else links.union(new), "links")
        labels = components(links)
        turn += 1
        if full:
            break
    if labels is None:
        return classes.withColumn("component", F.col("cid"))
    return (classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            .withColumn("component", F.coalesce("component", "cid")))


def _across(labelled: DataFrame, held: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Rows of one bucket in different components, sizes within the length filter: components are
    paired first, then their members looked up, so pairs inside a component are never formed."""
    sizes = held.join(mixed.select("token"), "token", "left_semi")
    one = sizes.select("token", F.col("component").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("left").alias("ra"))
    two = sizes.select("token", F.col("component").alias("cb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("left").alias("rb"))
    near = one.join(two, "token").where(
        f"ca < cb AND 100L * hb >= {percent}L * la AND 100L * ha >= {percent}L * lb "
        f"AND least(ra, rb) >= {_needed(percent, 'la', 'lb')}").select("token", "ca", "cb")
    x = labelled.select("token", F.col("component").alias("ca"), F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    y = labelled.select("token", F.col("component").alias("cb"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    return (near.join(x, ["token", "ca"]).join(y, ["token", "cb"])
            .where(f"100L * nx >= {percent}L * ny AND 100L * ny >= {percent}L * nx "
                   f"AND least(nx - ix, ny - iy) >= {_needed(percent, 'nx', 'ny')}"))


def components_by_jaccard(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text",
                          width: int = 5) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``row`` (this run's row number) and
    ``component_id``, the smallest id reachable by links."""
    ship(docs.sparkSession)
    rows = prefixes(docs, percent, id_column, text, width)
    classes = link_classes(docs, rows, percent, id_column, text, width)
    names = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    known = stored(classes.join(names, "component").select("sig", "component_id", "component"), "named")
    return (rows.select("row", "id", "n", "sig").join(known, "sig", "left")
            .select(F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    "row", F.coalesce("component", "row").alias("component")))


def keep_one(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null ids last), then the first row.

    The rows are written once with a row number, so that those to leave out, which are few where
    near duplicates are, can be named by it; documents without words are all kept."""
    at = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_of"),
                            F.monotonically_increasing_id().alias("at")), "numbered")
    numbered = at.select(F.col("at").alias("id"), F.col(f"row_of.`{text}`").alias("text"))
    found = components_by_jaccard(numbered, percent, "id", "text", width).where("n_shingles > 0")
    ids = at.select(F.col("at").alias("id"), F.col(f"row_of.`{id_column}`").alias("doc"))
    best = F.min(F.struct(F.col("doc").isNull().alias("unknown"), F.col("doc"), F.col("id")))
    first = found.join(ids, "id").groupBy("component").agg(best.alias("best")).select(F.col("best.id").alias("id"))
    spare = stored(found.select("id").join(first, "id", "left_anti"), "spare").withColumnRenamed("id", "at")
    if spare.count() <= BROADCAST_IDS:
        spare = F.broadcast(spare)
    return at.join(spare, "at", "left_anti").select("row_of.*")
