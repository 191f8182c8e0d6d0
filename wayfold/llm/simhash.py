"""SimHash near-dedup (operator 3).

Method: Golay-code fuzzy hashing.  A 23-bit segment decodes, with each of its
23 one-bit neighbours, to one or six codewords of the perfect Golay code; two
segments that differ in at most 2 bits share one of these codewords.  By the
pigeonhole principle 4 differing bits over the segments (23, 23, 18) fall in
one of these cases, each a family of keys:

  A  at most 2 in each of the first two        codeword x codeword
  B  3 or more in the first, so 1 at most in the other two:
     the third equal and the second within 1, or the reverse
  C  the same with the first two segments exchanged

Within distance 1 only texts of even parity need all neighbours, as the two
sides have unequal parity.  Keys are joined by a shuffle on the key; links are
verified on the 64 bits.  Equal fingerprints are one item from the start, so a
group of copies costs one item, and a key with many items gives a spanning
forest of its verified links and not all pairs: components come out the same
and the number of links stays below the number of keys.  A key with more than
``RUN`` items is dealt to pairs of blocks, so that no task holds it whole.

Components are found by alternating large-star and small-star steps on the
links, kept in the shared folder.

Texts: A-Z become lower case, words are runs of [^\\x20\\x09-\\x0D], shingles of
``SHINGLE`` words with repeats; a text with fewer words is one shingle, a text
with none (null, empty) has fingerprint zero, linked like any other.  Rows with
a null doc_id get a row, too; component_id is the smallest doc_id that is not
null.  Repeated rows and texts share a component; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrow import slices
from wayfold.llm.store import discard, documents, materialise, materialise_texts, text_batches

SHINGLE = 4
MOST = 4
HASH_SEED = 42
#: Items of one key that a task holds at a time.
RUN = 200_000
#: Hashes whose bits are counted at a time.
PIECE = 1 << 14
#: Links that one file of a step holds, about.
EDGES_A_FILE = 500_000
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int, seed: int = HASH_SEED):
    """XXH64 of each word shingle of a text, in pieces; nothing for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    del words
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), PIECE):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + PIECE], last[at : at + PIECE], strict=True)], np.uint64)


def majority(pieces) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, kind: str = "long") -> DataFrame:
    """doc_id (of a type) and fp (the fingerprint's bits as a long)."""

    def run(batches):
        for batch in batches:
            found = np.array([majority(shingle_hashes(x.as_py() or b"", width)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------ Golay code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator, 11 bits."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def _error_table() -> np.ndarray:
    """The one error pattern of weight 3 or less for each of the 2048 syndromes."""
    bits = 1 << np.arange(23)
    one = bits
    two = (bits[:, None] | bits)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | bits).ravel())
    patterns = np.concatenate([[0], one, two, three[np.bitwise_count(three) == 3]])
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


class Golay:
    def __init__(self):
        self.errors = _error_table()
        self.flips = np.concatenate([[0], 1 << np.arange(23)])
        self.of_flip = _syndromes(self.flips)

    def nearby(self, segment: np.ndarray, only_even: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, codeword index) of the codewords that a segment and its one-bit neighbours decode to, without repeats.

        ``only_even``: rows of odd parity decode alone, enough for distance 1.
        """
        s = segment.astype(np.int64)
        words = s[:, None] ^ self.flips
        index = (words ^ self.errors[_syndromes(s)[:, None] ^ self.of_flip]) >> 11
        if only_even:
            odd = np.bitwise_count(s) % 2 == 1
            index[odd] = index[odd, :1]
        index.sort(axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        return np.nonzero(new)[0], index[new]


def pair_keys(code: Golay, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for segments a and b that both differ in 2 bits at most: all pairs of their codewords."""
    ra, ca = code.nearby(a)
    rb, cb = code.nearby(b)
    na, nb = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(a))
    times = nb[ra]
    row, left = np.repeat(ra, times), np.repeat(ca, times)
    start = np.cumsum(nb) - nb
    within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, (left << 12) | cb[start[row] + within] if len(na) else left


def keys_of(code: Golay, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for 64-bit fingerprints within 4 bits; the family stands in the key's top bits."""
    first, second, third = (fp & 0x7FFFFF).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(46)).astype(np.int64)
    row, key = pair_keys(code, first, second)
    rows, keys = [row], [key]
    near3 = code.nearby(third, True)
    for family, segment in ((1, second), (2, first)):
        row, word = code.nearby(segment, True)
        rows.append(row)
        keys.append((family * 2 - 1 << 40) | (word << 18) | third[row])
        row, word = near3
        rows.append(row)
        keys.append((family * 2 << 40) | (word << 23) | segment[row])
    return np.concatenate(rows), np.concatenate(keys)


# ----------------------------------------------------------------------- links


def forest(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the items within ``most`` bits of each other."""
    if len(x) <= 256:
        near = np.bitwise_count(x[:, None] ^ x) <= most
        if near.sum() == len(x):
            return x[:0], x[:0]
    a, b, left = [], [], x
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            at = wave.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                got = left[near]
                a.append(np.full(len(got), at))
                b.append(got)
                wave.extend(got)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def _runs(batches, limit: int | None):
    """Whole runs of equal keys from batches sorted by key: (key, items), or (key, items, True) for parts of a run above ``limit``."""
    held_key, held, over = None, [], False

    def ended():
        if held_key is not None:
            yield held_key, np.concatenate(held), over

    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[a] != held_key:
                yield from ended()
                held_key, held, over = keys[a], [], False
            held.append(fps[a:b])
            if limit and sum(map(len, held)) > limit:
                over = True
                yield held_key, np.concatenate(held), True
                held = [fps[:0]]
    yield from ended()


LINKS = "a long, b long, key long"


def _link(limit: int | None, most: int):
    """Kernel over batches sorted by key: links (key null), or the items of overlong keys (b null)."""

    def run(batches):
        a, b, k, size = [], [], [], 0

        def flush():
            left = np.concatenate(a).view(np.int64) if a else np.zeros(0, np.int64)
            right, key = (np.concatenate(b), np.concatenate(k)) if b else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=key >= 0), pa.array(key, mask=key < 0)], names=["a", "b", "key"])

        def small(batch_rows):
            for key, items, over in batch_rows:
                if over:
                    yield items, np.zeros(len(items), np.int64), np.full(len(items), key)
                elif len(items) > 1:
                    left, right = forest(items, most)
                    if len(left):
                        yield left, right.view(np.int64), np.full(len(left), -1)

        for left, right, key in small(_runs(batches, limit)):
            a.append(left)
            b.append(right)
            k.append(key)
            size += len(left)
            if size > 50_000:
                yield flush()
                a, b, k, size = [], [], [], 0
        yield flush()

    return run


def _only_shared(batches):
    """Drop keys that one row has, batch by batch; keys at a batch's edges stay."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if len(keys) > 2:
            same = np.zeros(len(keys), bool)
            same[1:] = keys[1:] == keys[:-1]
            same[:-1] |= keys[1:] == keys[:-1]
            same[0] = same[-1] = True
            batch = batch.filter(pa.array(same))
        yield batch


def links(distinct: DataFrame, keys=keys_of, most: int = MOST, run_limit: int = RUN) -> DataFrame:
    """a and b: links that join the distinct fingerprints (column fp) into the components of all links."""

    def expand(batches):
        code = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                row, key = keys(code, some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row].view(np.int64))], names=["key", "fp"])

    kernel = _link(run_limit, most)
    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(keyed.mapInArrow(lambda batches: kernel(_only_shared(batches)), LINKS), "links")
    over = found.where(F.col("b").isNull()).select("key", F.col("a").alias("fp"))
    if not over.isEmpty():
        # each pair of blocks of an overlong key is one run
        blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (run_limit // 2)).cast("long").alias("n"))
        dealt = over.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")))
        dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pair = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).bitwiseAND(F.lit((1 << 62) - 1)).alias("key")
        whole = _link(None, most)
        more = dealt.select(pair, "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(whole, LINKS)
        found = found.where(F.col("b").isNotNull()).unionByName(more)
    return found.select("a", "b").where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for every node of the links a, b.

    Large-star links each larger neighbour of a node to the node's least
    neighbour; small-star links a node's smaller neighbours to it.  They
    alternate until nothing changes, which takes about log n rounds.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    files, state = 1 + edges.count() // EDGES_A_FILE, None  # steps never add edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(small, label, files)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == state or now[0] == 0:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_of(prints: DataFrame) -> DataFrame:
    """fp and root (the smallest fingerprint of its component) of the distinct fingerprints that have links."""
    return components(links(prints)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    member = component_of(groups).join(groups, "fp").select("fp", "root", "least")
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(of_root, "root").select("fp", "component_id")
    by_print = groups.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(by_print, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns: the one whose doc_id is the component's (null last, then the smaller row key).

    Rows equal in id and text stay or go together.
    """
    keyed = docs.select(F.struct(docs[id_col].cast("long").alias("doc_id"), *row_key(docs[id_col], docs[text_col])).alias("row"), docs[text_col].alias("text"))
    with text_batches(docs.sparkSession):
        rows = materialise(fingerprints(keyed, "row", "text", kind="struct<doc_id: long, rk: long, rk2: long>").select("doc_id.*", "fp"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "rk2")
    groups = materialise(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    root = groups.join(component_of(groups), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = root.groupBy("root").agg(F.min("least").alias("first"))
    by_print = root.join(first, "root").select("fp", "first")
    gone = rows.join(by_print, "fp").where((F.col("rk") != F.col("first.rk")) | (F.col("rk2") != F.col("first.rk2")))
    return without(docs, gone, id_col, text_col)


# ------------------------------------------- similarity of word shingles, 0.8

#: Word shingles of the similarity, and the least similarity of near copies.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many is counted to find common shingles; a shingle is common from so many of these texts on.
COUNTED, COMMON = 8, 3
#: Common shingles that are sent to the tasks at most; which ones are sent changes the order of shingles only, never the result.
MOST_COMMON = 500_000
#: Counts of a text's shingles by hash, modulo 256; they bound the similarity of two texts from above.
CELLS = 128
#: Pairs of open items of one shingle that are compared inside a join; items of a shingle with more must share further shingles, up to so many.
OPEN, DEEPER = 1 << 24, 3
#: Texts whose shingles a task holds at once.
ROWS = 256
#: Stands for the shingles of a text without words.
NO_SHINGLE = np.zeros(1, np.uint64)


def shingle_set(text: bytes, width: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def set_name(grams: np.ndarray) -> tuple[int, int]:
    """A shingle set's name of 128 bits, as two signed numbers; texts with equal sets are one item."""
    import xxhash

    name = xxhash.xxh3_128_intdigest(grams.tobytes(), HASH_SEED)
    return (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63)


def rare_prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rarest first, and how many of them are its prefix: two sets at the similarity share one of theirs.

    Sets that are ``SIMILARITY`` alike share that part of either, so fewer than
    the rest of a set can come before the first shared shingle in any order.  In
    the same way they share k of the prefixes with k - 1 shingles more; up to
    ``DEEPER`` more are given.
    """
    if not len(grams):
        return NO_SHINGLE, 1
    length = len(grams) - int(np.ceil(SIMILARITY * len(grams) - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        often = np.where(common[at] == grams, counts[at], 0)
        if often.any():
            grams = grams[np.lexsort((grams, often))]
    return grams[: length + DEEPER], length


def cells(grams: np.ndarray) -> bytes:
    return np.bincount((grams % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint8).tobytes()


def parities(grams: np.ndarray) -> np.ndarray:
    """Whether each of 256 other cells has an odd number of shingles, as four numbers."""
    odd = np.bincount((grams >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: Columns of the parities.
PARITIES = ["q0", "q1", "q2", "q3"]


def near_enough(one: str, two: str):
    """False only where sizes and parities of two items (columns with these suffixes) rule the similarity out: a shingle of one set alone turns one parity."""
    n1, n2 = F.col(f"n{one}"), F.col(f"n{two}")
    apart = sum((F.bit_count(F.col(f"{q}{one}").bitwiseXOR(F.col(f"{q}{two}"))) for q in PARITIES), F.lit(0))
    return F.greatest(apart, F.abs(n1 - n2)) <= (n1 + n2) * F.lit((1 - SIMILARITY) / (1 + SIMILARITY)) + F.lit(1e-6)


def may_be_similar(n1: np.ndarray, n2: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """False only where sizes and cells rule the similarity out.

    Each shingle of one set alone changes one cell by one, so the cells' distance
    is at most the number of such shingles, which the similarity bounds.
    """
    d = c1 - c2  # wraps
    apart = np.minimum(d, -d).sum(1, dtype=np.int64)
    return np.maximum(apart, np.abs(n1 - n2)) <= (n1 + n2) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and in how many of the texts counted they are."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, 100):
                grams = np.concatenate([np.zeros(0, np.uint64), *(shingle_set(x.as_py() or b"") for x in some.column(0))])
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    counted = rows.where(F.pmod("rk", F.lit(COUNTED)) == 0).select("text").mapInArrow(run, "gram long")
    with text_batches(rows.sparkSession):
        found = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).toArrow()
    grams, counts = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rk, rk2 and whether it stays (``stays``) of every row that has near copies, for rows keyed by ``row_key``.

    Texts with equal shingle sets are one item.  Candidates share a shingle of
    their prefixes of rare shingles, as all texts at the similarity do.  Each item
    of a key is compared with the key's hub by the Jaccard similarity of the word
    shingles; items that these links leave apart are compared with each other, so
    no link between components is lost.  Where more than ``OPEN`` pairs of a
    key's items are apart, only those are compared that share a second rare
    shingle of their longer prefixes, too, a third where that is still too many,
    and so on.  Of each
    component the smallest doc_id stays (null last, then the smaller row key).
    Null and empty texts are one item without words; texts of any length are
    read whole; rows equal in id and text stay or go together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).select("doc_id", *row_key("doc_id", "text"), "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows))

    def prefixes(batches):
        for batch in batches:
            for some in slices(batch, ROWS):
                sets = [shingle_set(x.as_py() or b"") for x in some.column("text")]
                names, rare = [set_name(g) for g in sets], [rare_prefix(g, *common.value) for g in sets]
                columns = (
                    pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([cells(g) for g in sets], pa.binary()),
                    *(pa.array(q) for q in np.array([parities(g) for g in sets], np.int64).reshape(len(sets), 4).T.copy()), pa.array([g.view(np.int64) for g, _ in rare], pa.list_(pa.int64())), pa.array([length for _, length in rare], pa.int32()),
                )
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "rk", "rk2")), *columns], names=["doc_id", "rk", "rk2", "i1", "i2", "n", "cells", *PARITIES, "rare", "length"])

    printed = materialise_texts(rows.mapInArrow(prefixes, "doc_id long, rk long, rk2 long, i1 long, i2 long, n long, cells binary, q0 long, q1 long, q2 long, q3 long, rare array<long>, length int"), "prefixes")
    firsts = [F.first(c).alias(c) for c in ("n", "cells", *PARITIES, "rare", "length")]
    items = printed.groupBy("i1", "i2").agg(F.min(F.struct("rk", "rk2")).alias("row"), *firsts)
    items = materialise(items.select(F.monotonically_increasing_id().alias("item"), "i1", "i2", "row.rk", "row.rk2", "n", "cells", *PARITIES, "rare", "length"), "items")
    members = materialise(printed.select("doc_id", "rk", "rk2", "i1", "i2"), "members")
    discard(printed)

    # a frequent shingle is summed up before it is shuffled, and its items are joined, not gathered
    keyed = items.select(F.explode(F.slice("rare", F.lit(1), F.col("length"))).alias("key"), "item")
    turn = F.xxhash64("key", "item")  # another hub for other keys
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(turn).alias("least")).where("c > 1").select("key", "least")
    shared = materialise(keyed.join(keys, "key").select("key", "item", (turn == F.col("least")).alias("is_hub")), "shared-shingles")
    hubs = shared.where("is_hub").select("key", F.col("item").alias("hub"))

    def possible(batches):
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n1", "n2")]
            c = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("c1", "c2")]
            yield batch.select(["x", "y"]).filter(pa.array(may_be_similar(*n, *c), pa.bool_()))

    def likely(pairs: DataFrame, label: str) -> DataFrame:
        one, two = (items.select(F.col("item").alias(i), F.col("n").alias(f"n{k}"), F.col("cells").alias(f"c{k}")) for i, k in (("x", 1), ("y", 2)))
        both = pairs.join(one, "x").join(two, "y").select("x", "y", "n1", "n2", "c1", "c2")
        return materialise(both.mapInArrow(possible, "x long, y long"), label)

    def sets(batches):
        for batch in batches:
            for some in slices(batch, ROWS):
                yield pa.RecordBatch.from_arrays([some.column("item"), pa.array([shingle_set(x.as_py() or b"").tobytes() for x in some.column("text")], pa.binary())], names=["item", "grams"])

    def verify(batches):
        for batch in batches:
            good = [similarity(*(np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("g1", "g2"))) >= SIMILARITY for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        wanted = pairs.select(F.col("x").alias("item")).unionByName(pairs.select(F.col("y").alias("item"))).distinct()
        of_rows = items.join(wanted, "item", "left_semi").select("item", "rk", "rk2")
        grams = materialise_texts(rows.join(of_rows, ["rk", "rk2"]).select("item", "text").mapInArrow(sets, "item long, grams binary").dropDuplicates(["item"]), "shingles")
        one, two = (grams.select(F.col("item").alias(i), F.col("grams").alias(f"g{k}")) for i, k in (("x", 1), ("y", 2)))
        both = pairs.join(one, "x").join(two, "y").select("x", "y", "g1", "g2")
        found = materialise(both.mapInArrow(verify, "x long, y long").select(F.col("x").alias("a"), F.col("y").alias("b")), label)
        discard(grams)
        return found

    to_hubs = shared.where("NOT is_hub").join(hubs, "key").select(F.least("item", "hub").alias("x"), F.greatest("item", "hub").alias("y")).distinct()
    pairs = likely(to_hubs, "hub-pairs")
    similar = verified(pairs, "similar-to-hubs")
    stars = components(similar, "similar")
    # what shares a key but is not in one component yet
    root = items.join(stars.withColumnRenamed("node", "item"), "item", "left").select("item", F.coalesce("root", "item").alias("root"), "n", *PARITIES)
    apart = open_keys(shared.join(root, "item").select("key", F.array("key").alias("used"), "item", *APART), items)
    one, two = (apart.select(F.col("key").alias(f"key{k}"), F.col("item").alias(i), *[F.col(c).alias(f"{c}{k}") for c in APART]) for i, k in (("x", 1), ("y", 2)))
    # pairs that sizes and parities rule out don't leave the join
    rest = one.join(two, (F.col("key1") == F.col("key2")) & (F.col("x") < F.col("y")) & (F.col("root1") != F.col("root2")) & near_enough("1", "2")).select("x", "y").distinct()
    others = likely(rest.join(pairs, ["x", "y"], "left_anti"), "other-pairs")
    for table in (apart, shared, pairs):
        discard(table)
    more = verified(others, "similar-to-others")
    if not more.isEmpty():
        stars = components(similar.unionByName(more), "similar")
    linked = stars.join(items.select(F.col("item").alias("node"), "i1", "i2"), "node").select("i1", "i2", "root")
    twins = members.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").join(items.select("i1", "i2", "item"), ["i1", "i2"]).join(linked.select("i1", "i2"), ["i1", "i2"], "left_anti")
    grouped = linked.unionByName(twins.select("i1", "i2", F.col("item").alias("root")))  # rows of one item are a group of their own
    member = members.join(grouped, ["i1", "i2"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rk", "rk2")
    stays = member.groupBy("root").agg(F.min(order).alias("first"))
    return member.join(stays, "root").select("rk", "rk2", ((F.col("rk") == F.col("first.rk")) & (F.col("rk2") == F.col("first.rk2"))).alias("stays"))


#: What the open items of a key carry.
APART = ["root", "n", *PARITIES]


def open_keys(rows: DataFrame, items: DataFrame) -> DataFrame:
    """key, item and what ``APART`` names of the keys whose items are apart, with ``OPEN`` pairs a key or all the shingles that prefixes give."""

    def apart(some: DataFrame, label: str) -> DataFrame:
        mixed = some.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return materialise(some.join(mixed, "key", "left_semi"), label)

    rows, done = apart(rows, "open-shingles"), None
    for deeper in range(1, DEEPER + 1):
        of_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        frequent = materialise(of_root.where((F.col("c") * F.col("c") - F.col("squares")) / 2 > OPEN).select("key"), "frequent-shingles")
        if frequent.isEmpty():
            break
        few = rows.join(frequent, "key", "left_anti")
        done = few if done is None else done.unionByName(few)
        longer = rows.join(frequent, "key", "left_semi").join(items.select("item", F.slice("rare", F.lit(1), F.col("length") + deeper).alias("rare")), "item")
        next_one = longer.select("key", "used", "item", *APART, F.explode("rare").alias("then")).where(~F.array_contains("used", F.col("then")))
        rows = apart(next_one.select(F.xxhash64("key", "then").alias("key"), F.array_append("used", F.col("then")).alias("used"), "item", *APART), "open-shingles")
    return (rows if done is None else done.unionByName(rows)).select("key", "item", *APART)


def row_key(id_col, text_col) -> list:
    """A row's key of 128 bits by id and text (names or columns), as rk and rk2; rows equal in both are one."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    both = col(id_col).cast("long"), col(text_col).cast("binary")
    return [F.xxhash64(*both).alias("rk"), F.xxhash64(F.lit(1), *both).alias("rk2")]


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose keys are in ``gone``, all columns.  Rows travel as one struct, so columns may have any names."""
    gone = materialise(gone.select("rk", "rk2").distinct(), "near-copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.select("row", *row_key("id", "text")).join(gone, ["rk", "rk2"], "left_anti").select("row.*")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of near copies by the similarity of their word shingles."""
    return without(docs, near_copies(docs, id_col, text_col).where("NOT stays"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
