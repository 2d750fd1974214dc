"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits of each other have a common variant within r bits of both. So every distinct
fingerprint stands for all its variants within r = radius / 2 flips, the variants are shuffled, equal ones meet,
and the colliding pairs are deduplicated and verified.

What is shuffled is not a row for each of the 2,081 variants (r = 2) but a row for each *prefix* that variants of a
fingerprint can have: a variant's first ``bits`` bits name its bucket, so a fingerprint goes once to its own bucket
and to those one or two flips away, and its variants in a bucket are written out there. ``bits`` grows with the
logarithm of the number of fingerprints. A bucket with far more than its share is split by more bits of the variant, and what is
still too much there is shuffled on the whole variants, linked by each one's least owner: work grows with the rows, not their
square. No variant is left out. Each bucket returns a spanning forest of its links, not the links; the
forests are joined into components by alternating large and small stars, with a written table after each round.

``near_duplicates`` links texts whose sets of shingles are similar (Jaccard, ``TENTHS`` / 10 at least); its components are those of all
similar pairs. One fingerprint of 64 bits can't give them: at 0.8 two differ in 10 bits on average, and balls of half of that are too large
to write out. So each text has ``TABLES`` independent fingerprints of ``WIDTH`` bits, and texts meet that are within ``NEAR`` bits in any
of them. Pairs that meet are verified by their exact similarity before they count: links of the forests, and each text of a component
against one of it (a hub), then those left over against another one, for as long as that links any. What is then still apart, because its
fingerprints are far or it met no hub, goes through an exact way: with shingles in one order (common ones last), two similar sets have one in
common among their first fifths (``prefix``), and all pairs of different components that do are verified, unless their sizes, the places of the
first one that they have in common (few can follow a late one) or the number of those rule them out. What pairs with one hub of a shingle link
needs no other pair, so these go first; then come all pairs that are still apart. So the number of tables decides what is verified where, not what is found. Width and radius let random texts
meet rarely up to some 5e9 different texts.

Defined results: null and empty texts have fingerprint zero, which links like any other; a text of fewer words than a
shingle has is one shingle; copies share a fingerprint and so a component; a component is named by its smallest id
(null only if it has no other). Repeated rows keep their own output rows. Column names of ``fingerprints`` are chosen by
the caller; ``components`` uses only the two columns it is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.llm.common import bits_for, few, released, remembered, stored

SEED = 42
#: Fingerprints whose variants fill a bucket, about (an eighth of that beyond two flips); with so many times more a bucket
#: is split.
PER_BUCKET, HOT = 8_000, 2
#: Of near-duplicates: fingerprints of a text, their bits, the radius, the least similarity in tenths.
TABLES, WIDTH, NEAR, TENTHS = 4, 52, 4, 8
#: Texts whose shingles are counted to put common ones last, about; texts of these that make a shingle common, common ones at most.
SAMPLED, COMMON, MOST_COMMON = 20_000, 3, 1 << 18
#: Orders in which hubs are chosen.
ORDERS = 6
#: Pairs of one hub that are verified together, about; numbers of sets that are broadcast, at most (16 MB).
TOGETHER, NAMED = 1_000, 2_000_000
#: Rows for each text that tables of pairs and lists are dealt for.
MANY = 4
#: Lists before one in a set that are looked at, to leave out pairs that these have.
BEFORE = 8
#: Shingles hashed at once; variants of a bucket sorted at once.
BLOCK, SLICE = 65_536, 4_000_000
#: Bytes of a text that are split into words at once.
LONG = 4_000_000
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, from slices of a few megabytes."""
    at = 0
    while len(text) - at > LONG and (m := _WHITE.search(text, at + LONG)):
        yield text[at : m.start()].split()
        at = m.start()
    yield text[at:].split()


def fingerprint(text: str, words: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    ones, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    before: list[bytes] = []
    for some in _words(text.encode().lower()):
        parts = before + some
        if len(parts) < words:
            before = parts
            continue
        before = parts[len(parts) - words + 1 :]
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        made = len(parts) - words + 1
        ends, begins = ends[words - 1 :].tolist(), begins[:made].tolist()
        for at in range(0, made, BLOCK):
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += made
    if not n and before:  # fewer words than a shingle has
        return int(np.array([digest(b" ".join(before), SEED)], "<u8").view("<i8")[0])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: the SimHash of the text's shingles of ``words`` words, ASCII letters in lower case."""

    @F.arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        remembered("simhash")  # nothing is kept
        return pa.array((fingerprint(t.as_py() or "", words) for t in texts), pa.int64())

    return df.withColumn(out, hashed(F.col(f"`{text}`").cast("string")))


def _flips(width: int, most: int) -> list[int]:
    """Masks of at most ``most`` set bits out of ``width``."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(width), k)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, from links between nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _meet(prints: np.ndarray, used: np.ndarray, low_bits: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among ``prints`` whose variants meet in a bucket.

    ``used``: flips already spent on the bucket's prefix; the rest are made in the low bits. A variant is kept as a hash
    above its owner's number, so one sort brings equal ones together. Those of one hash are joined in a chain; where a link of it
    is over the radius, two variants share the hash, and all of its owners are compared. Variants are made in slices of bounded
    size, by their hash.
    """
    low = prints & np.uint64((1 << low_bits) - 1)
    by_left = [np.array(_flips(low_bits, k), np.uint64) for k in range(half + 1)]
    owner_bits = np.uint64(max(1, (len(prints) - 1).bit_length()))
    total = sum(int((used == half - k).sum()) * len(m) for k, m in enumerate(by_left))
    slices = max(1, -(-total // SLICE))
    links: list[np.ndarray] = []
    for s in range(slices):
        packed = []
        for k in range(half + 1):
            own = np.flatnonzero(used == half - k)
            masks = by_left[k]
            size = max(1, 2_000_000 // len(masks))
            for at in range(0, len(own), size):
                some = own[at : at + size]
                made = (low[some, None] ^ masks[None, :]) * _MIX
                made >>= owner_bits
                made <<= owner_bits
                made |= some.astype(np.uint64)[:, None]
                made = made.ravel()
                packed.append(made if slices == 1 else made[(made >> np.uint64(40)) % np.uint64(slices) == s])
        key = np.concatenate(packed)
        del packed
        key.sort()
        apart = key[1:] ^ key[:-1]
        apart >>= owner_bits
        same = np.flatnonzero(apart == 0)
        del apart
        of = (np.uint64(1) << owner_bits) - np.uint64(1)
        a, b = (key[same] & of).astype(np.int64), (key[same + 1] & of).astype(np.int64)
        far = same[np.bitwise_count(prints[a] ^ prints[b]) > radius]
        links.append(np.unique(a * len(prints) + b))
        for h in np.unique(key[far] & ~of):
            met = np.unique((key[np.searchsorted(key, h) : np.searchsorted(key, h | of, side="right")] & of).astype(np.int64))
            for k in range(1, len(met)):
                links.append(met[:-k] * len(prints) + met[k:])
    pair = np.unique(np.concatenate(links))
    a, b = pair // len(prints), pair % len(prints)
    close = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
    root = _forest(len(prints), a[close], b[close])
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def _masks(low: int, bits: int, half: int) -> Column:
    """Flips of at most ``half`` of the ``bits`` bits above bit ``low``, as an array of longs."""
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in (f << low for f in _flips(bits, half))])


def links(prints: DataFrame, radius: int = 4, column: str = "fingerprint", width: int = 64, tables: int = 1) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``column`` within ``radius`` (even) bits.

    ``prints`` has each fingerprint once. Every link joins two fingerprints of one component; each component is connected.
    Of ``tables`` kinds of fingerprints, the bits above ``width`` are the kind, and only those of one kind meet.
    """
    if radius % 2:
        raise ValueError("the radius must be even: two variants of half of it meet")
    half = radius // 2
    per_bucket = PER_BUCKET if half < 3 else max(1, PER_BUCKET // 8)
    bits = bits_for(-(-prints.count() // tables), per_bucket, least=4)
    low, most = width - bits, HOT * per_bucket * len(_flips(bits, half))
    print_, bucket = F.col("print"), F.col("bucket")
    sent = prints.select(F.col(column).alias("print")).withColumn("bucket", F.explode(F.transform(_masks(low, bits, half), lambda m: F.shiftrightunsigned(print_.bitwiseXOR(m), low))))
    parts = [sent.withColumn("low", F.lit(low))]
    sizes = stored(sent.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot")
    plain = None
    if greatest := sizes.agg(F.max("n")).first()[0]:
        # Hot buckets are split by further bits of the variants, as far as flips are left.
        more = min(bits_for(greatest, most, least=1), low, 16)
        hot = sent.join(sizes.select("bucket"), "bucket", "left_semi")
        left = half - F.bit_count(F.shiftrightunsigned(print_, low).bitwiseXOR(bucket))
        flipped = F.filter(_masks(low - more, more, half), lambda m: F.bit_count(m) <= left)
        within = F.shiftrightunsigned(print_, low - more).bitwiseAND(F.lit((1 << more) - 1))
        split = hot.withColumn("_m", F.explode(flipped)).select("print", (F.shiftleft(bucket, more) + within.bitwiseXOR(F.shiftrightunsigned("_m", low - more))).alias("bucket"))
        still = stored(split.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket"), "hotter")
        cold = sent.join(sizes.select("bucket"), "bucket", "left_anti").withColumn("low", F.lit(low))
        parts = [cold, split.join(still, "bucket", "left_anti").withColumn("low", F.lit(low - more))]
        # What is hot there is shuffled on whole variants: all owners of one are within the radius of each other.
        rest = low - more
        left = half - F.bit_count(F.shiftrightunsigned(print_, rest).bitwiseXOR(bucket))
        flipped = F.filter(_masks(0, rest, half), lambda m: F.bit_count(m) <= left)
        inside = print_.bitwiseAND(F.lit((1 << rest) - 1))
        whole = split.join(still, "bucket", "left_semi").select("print", F.explode(F.transform(flipped, lambda m: F.shiftleft(bucket, rest).bitwiseOR(inside.bitwiseXOR(m)))).alias("variant"))
        least = whole.groupBy("variant").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").select("variant", "b")
        plain = whole.join(least, "variant").where("print <> b").select(F.col("print").alias("a"), "b")

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket, low = (k.as_py() for k in key)
        own = group.column("print").to_numpy().view(np.uint64)
        used = np.bitwise_count((own >> np.uint64(low)) ^ np.uint64(bucket)).astype(np.int8)
        a, b = _meet(own, used, low, half, radius)
        released()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = [p.select("bucket", "low", "print").groupBy("bucket", "low").applyInArrow(meet, "a long, b long") for p in parts]
    return reduce(DataFrame.union, [*found, *([plain] if plain is not None else [])]).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by alternating large and small stars.

    A link is kept as (a, b), a above b, so what a large star moves are the links above a node: to the least below it, or to itself.
    Rounds go on while a node has several links, one of them to a node below it; no round is run only to see that it changes nothing,
    as the driver keeps the plans of all that was run.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = None
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(now.select("b", F.lit(0))).groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
        ends = ends if n is None else few(ends, n)
        n, unfinished = ends.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(F.expr("down > 0 AND n > 1"))).first()
        if not unfinished:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = few(now, n)
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = now.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        down = few(few(large, n).distinct(), n)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = few(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), n)
        small = joined.union(few(least.select("a", F.col("m").alias("b")), n)).distinct()
        now = stored(few(small, n), "stars")


def components(df: DataFrame, radius: int = 4, id_col: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """(id_col, column, component_id) for each row of ``df``: the smallest id that links of at most ``radius`` bits reach."""
    rows = stored(df.select(F.col(id_col).alias("id"), F.col(column).alias("print")), "prints")
    prints = stored(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    roots = stars(links(prints, radius, "print"))
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(of_print, "print").select(F.col("id").alias(id_col), F.col("print").alias(column), "component_id")


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles of words, ASCII letters in lower case, sorted; all words if there are fewer."""
    found, before = [], []
    for some in _words(text.encode().lower()):
        parts = before + some
        if len(parts) < words:
            before = parts
            continue
        before = parts[len(parts) - words + 1 :]
        found.append(_combined(parts, words))
    if not found and before:
        found.append(_combined(before, len(before)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _combined(parts: list[bytes], words: int) -> np.ndarray:
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    out = np.full(n, words, np.uint64)
    for k in range(words):
        out = (out ^ each[k : k + n]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def table_prints(own: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of hashes, one for each table, with the table's number above."""
    ones = np.zeros(TABLES * 64, np.int64)
    for at in range(0, len(own), 255):
        some = own[at : at + 255, None] ^ (np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))[None, :]
        some *= _MIX
        some ^= some >> np.uint64(29)
        some *= np.uint64(0xBF58476D1CE4E5B9)
        some ^= some >> np.uint64(32)
        # Eight counters of a byte each are added up as one number: 255 of them fit.
        lanes = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        ones += lanes.sum(axis=0, dtype=np.uint64).view(np.uint8)
    prints = np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)
    return ((prints & np.uint64((1 << WIDTH) - 1)) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(WIDTH))).view(np.int64)


def _set_number(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def with_sets(df: DataFrame, words: int = 5, text: str = "text", out: str = "set") -> DataFrame:
    """Add ``out``: the number of the text's set of shingles, as ``near_duplicates`` has it."""

    @F.arrow_udf("bigint")
    def numbered(texts: pa.Array) -> pa.Array:
        return pa.array((_set_number(shingles(t.as_py() or "", words)) for t in texts), pa.int64())

    return df.withColumn(out, numbered(F.col(f"`{text}`").cast("string")))


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of the column ``text``, sorted, and the bits of their number of texts.

    They only order the shingles of a set, so a sample is enough.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("simhash")  # nothing is kept
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found, n = np.unique(np.concatenate([shingles(t.as_py(), words) for t in batch.column(0)[at : at + 500]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["token", "n"])
        released()

    step = max(1, texts.count() // SAMPLED)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).mapInArrow(counted, "token long, n long")
    several = some.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = several.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    token, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], np.ceil(np.log2(n + 1)).astype(np.int8)[order]


def prefix(own: np.ndarray, common: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """The first hashes of a set, common ones last, so many that every similar set has one of them among its own first ones."""
    n = len(own)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, grades[at], 0), kind="stable")]
    return own[: n - -(-TENTHS * n // 10) + 1]


def _rooted(rows: DataFrame, alike: DataFrame, n: int) -> DataFrame:
    """Add ``root``: that of the row's set, or the set itself. ``alike`` (stored) has the roots of linked sets, of ``n`` texts."""
    few = n <= NAMED or alike.count() <= NAMED
    return rows.join(F.broadcast(alike) if few else alike, "set", "left").withColumn("root", F.coalesce("root", "set"))


def _mixed(rows: DataFrame, key: str, root: Column, n: int) -> DataFrame:
    """The rows of keys whose sets have different roots, as ``root`` tells them apart; ``n``: about the number of keys."""
    seen = rows.select(key, root.alias("of")).groupBy(key).agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high")
    mixed = stored(few(seen.select(key), n), "mixed")
    return rows.join(F.broadcast(mixed) if mixed.count() <= NAMED else mixed, key, "left_semi")


def _lists(rows: DataFrame, alike: DataFrame, n: int) -> DataFrame:
    """(list, set, size, place): the sets of each hash in prefixes whose sets have different roots, and its place in each one's prefix.

    ``rows`` (stored): set, size, prefix. Hashes of the same sets are one list, with the first place: of these, two sets meet first at the first one.
    Hashes are cut to 40 bits here, and a list is named by a hash of its sets; either can only add pairs or move places forward. Roots are told
    apart by 24 bits, other ones for each hash.
    """
    bits = F.xxhash64("root", "token").bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    tokens = _rooted(rows.select("set", "size", "prefix"), alike, n).select("set", "root", "size", F.posexplode("prefix").alias("place", "token")).withColumn("token", F.col("token").bitwiseAND(F.lit((1 << 40) - 1)))
    shared = stored(few(_mixed(tokens, "token", bits, n).groupBy("token", "set", "size").agg(F.min("place").alias("place")), MANY * n), "shared")
    named = shared.groupBy("token").agg(F.bit_xor(F.xxhash64("set")).alias("list"))
    met = few(shared.join(named, "token"), MANY * n).groupBy("list", "set", "size").agg(F.min("place").alias("place"))
    return stored(few(met, MANY * n), "lists")


def _may_be_similar(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Of two sets of different roots that have a hash in common, at a place in each one's order: whether they can be similar if it is the first such one."""
    enough = (10 + TENTHS) * F.least(x["size"] - x["place"], y["size"] - y["place"]) >= TENTHS * (x["size"] + y["size"])
    return (x["root"] != y["root"]) & enough & (10 * y["size"] >= TENTHS * x["size"]) & (10 * x["size"] >= TENTHS * y["size"])


def _columns(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in ("list", "set", "root", "size", "place")}


def _hub_pairs(lists: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b): the sets of each list with its hub, where they may be similar.

    The hub has the list's hash first of all: texts with changes of their own have rarer hashes before it.
    """
    hubs = lists.groupBy("list").agg(F.min_by(F.struct("set", "root", "size", "place"), F.struct("place", "set")).alias("hub")).select("list", "hub.*")
    x, y = _columns("x"), _columns("y")
    met = lists.alias("x").join(hubs.alias("y"), (x["list"] == y["list"]) & _may_be_similar(x, y))
    return few(met.select(x["set"].alias("a"), y["set"].alias("b")), MANY * n).distinct()


def _all_pairs(lists: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b) of the sets of each list that may be similar. A list of many sets is dealt to parts.

    Two sets with many lists in common are a pair of the first one: a later one is left out where a list shortly before it is in both sets, too.
    """
    earlier = Window.partitionBy("set").orderBy("place", "list").rowsBetween(-BEFORE, -1)
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    dealt = few(few(lists.withColumn("before", F.collect_list("list").over(earlier)), MANY * n).join(parts, "list"), MANY * n)
    longer = dealt.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).alias("x")
    shorter = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    x, y = _columns("x"), _columns("y")
    later = (y["size"] < x["size"]) | ((y["size"] == x["size"]) & (y["set"] < x["set"]))
    met = longer.join(shorter, (x["list"] == y["list"]) & (F.col("x.part") == F.col("y.part")) & later & _may_be_similar(x, y) & ~F.arrays_overlap("x.before", "y.before"))
    return few(met.select(x["set"].alias("a"), y["set"].alias("b")), MANY * n).distinct()


def _by_prefixes(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Those of the distinct (a, b) (stored) that may be similar by the number of hashes that their prefixes share."""
    asked = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    firsts = stored(few(rows.select("set", "size", "prefix").join(asked, "set", "left_semi").dropDuplicates(["set"]), n), "firsts")
    of_a, of_b = (firsts.select(F.col("set").alias(c), F.col("size").alias(f"n_{c}"), F.col("prefix").alias(f"of_{c}")) for c in "ab")
    # What two sets have in common beyond the lesser end of their prefixes is at most what the longer one has beyond its own.
    beyond = F.ceil(TENTHS * F.greatest("n_a", "n_b") / 10) - 1
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return few(pairs.join(of_a, "a"), MANY * n).join(of_b, "b").where((10 + TENTHS) * (shared + beyond) >= TENTHS * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _similar(a: bytes, b: bytes) -> bool:
    both = np.frombuffer(a + b, np.uint64).copy()
    both.sort(kind="stable")  # two sorted runs are merged
    common = np.count_nonzero(both[1:] == both[:-1])
    return bool((10 + TENTHS) * common >= TENTHS * len(both))


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those of the distinct (a, b) (stored) whose sets are similar; many pairs may have one b."""
    n = pairs.count()

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, of_a, of_b = batch.columns
            kept = pa.array([_similar(x.as_py(), y.as_py()) for x, y in zip(of_a, of_b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(kept)

    # A hub's set goes once to each part of its pairs, and most hubs have one part.
    sized = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    hubs = few(sized.join(members.select(F.col("set").alias("b"), F.col("members").alias("of_b")), "b"), MANY * n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = few(pairs.join(sized, "b"), MANY * n).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    both = few(dealt.join(members.select(F.col("set").alias("a"), F.col("members").alias("of_a")), "a"), MANY * n).join(hubs.select("b", "part", "of_b"), ["b", "part"])
    # No UDF below ``few``: each would keep a page of memory for each partition that a task takes, until the task ends.
    return few(both.select("a", "b", "of_a", "of_b"), MANY * n).mapInArrow(similar, "a long, b long")


def _joined(alike: DataFrame | None, verified: DataFrame) -> DataFrame:
    """(set, root) of all linked sets, by what was known of them and further links."""
    known = [] if alike is None else [alike.select(F.col("set").alias("a"), F.col("root").alias("b"))]
    return stars(reduce(DataFrame.union, known, verified)).select(F.col("node").alias("set"), "root")


def near_duplicates(df: DataFrame, words: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, set, component_id, kept_set) for each row of ``df``: its set of shingles, the smallest id that similar texts reach, and
    the set of a row with that id, so one (id, set) stands for each component.

    Null and empty texts have the empty set, which is similar to itself alone; equal sets are similar.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    common = df.sparkSession.sparkContext.broadcast(common_shingles(df.select(body.alias("text")), words))

    @F.arrow_udf("struct<set:bigint,prints:array<bigint>,size:bigint,prefix:array<bigint>>")
    def printed(texts: pa.Array) -> pa.Array:
        remembered("simhash")  # nothing is kept
        sets, prints = np.empty(len(texts), np.int64), np.empty((len(texts), TABLES), np.int64)
        sizes, firsts = np.empty(len(texts), np.int64), [np.zeros(0, np.uint64)]
        for k, text in enumerate(texts):
            own = shingles(text.as_py(), words)
            sets[k], prints[k], sizes[k] = _set_number(own), table_prints(own), len(own)
            firsts.append(prefix(own, *common.value))
        released()
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * TABLES, pa.int32()), pa.array(prints.ravel()))
        ends = np.cumsum([len(f) for f in firsts])
        first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(sets), each, pa.array(sizes), first], names=["set", "prints", "size", "prefix"])

    @F.arrow_udf("struct<set:bigint,members:binary>")
    def membered(texts: pa.Array) -> pa.Array:
        remembered("simhash")
        sets, ends, data = np.empty(len(texts), np.int64), np.zeros(len(texts) + 1, np.int64), bytearray()
        for k, text in enumerate(texts):
            own = shingles(text.as_py(), words)
            data += own.tobytes()
            sets[k], ends[k + 1] = _set_number(own), len(data)
        released()
        members = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        return pa.StructArray.from_arrays([pa.array(sets), members.cast(pa.binary())], names=["set", "members"])

    known = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("text"), printed(body).alias("p"))
    rows = stored(known.select("id", "text", "p.*"), "prints")
    n = rows.count()
    # Of equal sets one text is enough.
    texts = rows.groupBy("set").agg(F.min("text").alias("text"))

    def membered_sets(wanted: DataFrame) -> DataFrame:
        asked = stored(few(few(texts.join(wanted, "set", "left_semi").select("text"), n).distinct(), n), "wanted")
        if n <= NAMED or asked.count() <= NAMED:
            asked = F.broadcast(asked)  # else all texts are shuffled to meet them
        made = df.select(body.alias("body")).withColumn("text", F.xxhash64("body")).join(asked, "text", "left_semi")
        return stored(few(made.select(membered(F.col("body")).alias("m")).select("m.set", "m.members").dropDuplicates(["set"]), MANY * n), "members")

    nodes = rows.select("set", F.explode("prints").alias("node")).groupBy("node", "set").agg(F.lit(1).alias("one")).select("node", "set")
    nodes = stored(few(nodes, TABLES * n), "nodes")
    first = stored(few(nodes.groupBy("node").agg(F.min("set").alias("set"), (F.min("set") != F.max("set")).alias("shared")), TABLES * n), "first")
    near = stored(few(links(first.select("node"), NEAR, "node", WIDTH, TABLES), TABLES * n), "near")
    roots = stars(near)
    # Groups: texts of one component in one table. Only fingerprints that are linked or that several texts share have one.
    met = first.where("shared").select("node").union(roots.select("node")).union(roots.select("root")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    grouped = stored(few(few(nodes.join(met, "node").select("set", "group"), TABLES * n).distinct(), TABLES * n), "groups")
    members = membered_sets(grouped.select("set").distinct())
    ends = first.withColumnRenamed("set", "of")
    linked = few(near.join(ends.select(F.col("node").alias("a"), F.col("of").alias("x")), "a"), TABLES * n).join(ends.select(F.col("node").alias("b"), F.col("of").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike, left = None, grouped
    while True:
        # Groups of several tables have one hub, so few pairs are verified twice, and ``ORDERS`` different ones in all.
        order = F.pmod(F.shiftrightunsigned("group", WIDTH), F.lit(ORDERS))
        hubs = left.groupBy("group").agg(F.min_by("set", F.xxhash64("set", order)).alias("hub"))
        pairs = left.join(hubs, "group").select(F.col("set").alias("a"), F.col("hub").alias("b"))
        pairs = few((pairs if alike is not None else pairs.union(linked)).where("a <> b"), TABLES * n).distinct()
        pairs = stored(few(pairs, TABLES * n), "pairs")
        alike = _joined(alike, stored(_verified(pairs, members), "verified"))
        rooted = few(left.join(alike, "set", "left").select("group", "set", F.coalesce("root", "set").alias("root")), TABLES * n)
        hub_roots = few(few(hubs, n).withColumnRenamed("hub", "set").join(alike, "set", "left"), n).select("group", F.coalesce("root", "set").alias("of_hub"))
        apart = rooted.join(hub_roots, "group").withColumn("same", F.col("root") == F.col("of_hub"))
        # A group goes on while its hub was joined by another text and texts of two components or more are left.
        going = apart.groupBy("group").agg(F.count_if("same").alias("n"), F.min(F.when(~F.col("same"), F.col("root"))).alias("low"), F.max(F.when(~F.col("same"), F.col("root"))).alias("high")).where("n > 1 AND low <> high")
        left = stored(few(apart.where(~F.col("same")).join(going.select("group"), "group", "left_semi").select("group", "set"), TABLES * n), "left")
        if left.isEmpty():
            break
    # Similar texts that are still in different components meet by what they have in common: first each list's with a hub, as what that links
    # needs no other pair, then all that are still apart.
    lists, tried = _lists(rows, alike, n), None
    for met in (_hub_pairs, _all_pairs):
        pairs = few(met(_mixed(_rooted(lists, alike, n), "list", F.col("root"), n), n), MANY * n)
        pairs = pairs if tried is None else pairs.join(tried, (F.least("a", "b") == tried["low"]) & (F.greatest("a", "b") == tried["high"]), "left_anti")
        pairs = stored(few(pairs, MANY * n), "pairs")
        tried = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        pairs = stored(few(_by_prefixes(pairs, rows, n), MANY * n), "pairs")
        both = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        alike = _joined(alike, stored(_verified(pairs, membered_sets(both)), "verified"))
    least = rows.groupBy("set").agg(F.min("id").alias("least"))
    named = stored(few(least.join(alike, "set", "left").withColumn("root", F.coalesce("root", "set")), n), "named")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.when(F.col("least").isNotNull(), F.struct("least", "set"))).alias("kept")).select("root", "component_id", F.col("kept.set").alias("kept_set"))
    of_set = few(named.join(of_root, "root").select("set", "component_id", "kept_set"), n)
    return few(rows.select("id", "set").join(of_set, "set").select(F.col("id").alias(id_col), "set", "component_id", "kept_set"), n)
