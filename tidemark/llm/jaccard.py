"""Sets of word n-grams whose Jaccard similarity reaches a limit: universe partition and pigeonhole.

Sets are put in bands by size. Two sets in reach of each other differ in at
most H shingles, H known by band. All possible shingles are split by a hash
into segments; of H + 1 segments one must hold the same subset in both sets. A
segment may also stand for two of them when subsets that differ by one shingle
are found too, by the subsets with one shingle left out. How many of each kind
a band gets is chosen by cost. A few segments more than that are spared for
those that are empty, so that no two sets meet only because both have nothing
in a segment. Sets that meet are first held against each other by size and by
the parity of their shingles in a bit array, which proves most of them too far
apart before a text is moved; the others are compared exactly, on their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, join_narrow, query, stored, table
from .components import connected_components
from .workers import in_workers

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bands of set sizes end at powers of this.
BAND_RATIO = 1.5


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], width: int) -> set[tuple]:
    """Distinct runs of ``width`` words; fewer words are one shingle, none are no shingle."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums over sets depend on every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_shingles(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        total = np.zeros(1, np.uint64)
        for x in h:
            total = _mix(total * np.uint64(3) + x)
        return total + np.uint64(len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(3) + h[i : len(h) - width + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Band:
    """Set sizes low..high of the smaller set: segments matched exactly, and with one shingle off; spare ones among them."""

    low: int
    high: int
    exact: int
    loose: int
    spare: int = 0


def most_different(high: int, percent: int) -> int:
    """How many shingles two sets may differ in, the smaller holding at most ``high``, when 100 i >= percent u."""
    # The larger one has at most 100/percent times as many; i >= percent (s + t) / (100 + percent).
    return (high + high * 100 // percent) * (100 - percent) // (100 + percent)


def _beyond(mean: float, limit: int) -> float:
    """How likely a rare event with this mean happens more than ``limit`` times."""
    if mean > 50:
        return 0.5 * math.erfc((limit + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for k in range(1, limit + 1):
        term *= mean / k
        total += term
    return max(0.0, 1.0 - total)


def plan_bands(counts: dict[int, int], percent: int) -> list[Band]:
    """Segments of each band, from how many sets it has: ``counts`` by band number.

    A segment matched exactly costs one row to shuffle. With one shingle off
    allowed it stands for two, but costs one more row per shingle. A spare
    segment costs its rows too, and allows one more to be empty (or, with one
    off, to hold one shingle) before a set has to be found by its empty ones as
    well; that would cost a comparison with others that are as empty.
    """
    bands = []
    # One more at either end, should the two logarithms round apart.
    for number in range(min(counts) - 1, max(counts) + 2) if counts else ():
        low, high = band_range(number)
        if high < low:
            continue
        h = most_different(high, percent)
        few = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128]

        def cost(plan: tuple[int, int], n: int = counts.get(number, 0), size: float = (low + high) / 2, h: int = h) -> float:
            loose, spare = plan
            exact = max(h + 1 + spare - 2 * loose, 0)
            m = exact + loose
            held = size / m
            thin = exact * math.exp(-held) + 2 * loose * (1 + held) * math.exp(-held)
            return exact + loose * (1 + held) + 20 * _beyond(thin, spare) * (1 + n * math.exp(-held))

        looses = range((h + 2) // 2 + 1) if h < 64 else (0, (h + 2) // 8, (h + 2) // 4, (h + 2) // 2)
        loose, spare = min(((a, b) for a in looses for b in few), key=cost)
        bands.append(Band(low, high, max(0, h + 1 + spare - 2 * loose), loose, spare))
    return bands


def band_number(size: int) -> int:
    return int(math.floor(math.log(size, BAND_RATIO) + 1e-9))


def band_range(number: int) -> tuple[int, int]:
    """The least and the greatest size of a band."""
    start = lambda k: next(s for s in range(max(1, int(BAND_RATIO**k) - 2), int(BAND_RATIO**k) + 4) if band_number(s) >= k)
    return start(number), start(number + 1) - 1


def signatures(hashes: np.ndarray, bands: list[Band], percent: int) -> np.ndarray:
    """What a set is looked up by: for every band a partner's smaller set may be in."""
    size, out = len(hashes), []
    for band in bands:
        # The smaller of a pair that links has percent * size / 100 shingles at least.
        if band.low > size or band.high * 100 < percent * size:
            continue
        m = band.exact + band.loose
        seed = np.uint64((band.low * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        segment = ((_mix(hashes ^ seed) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        value = _mix(hashes + seed)
        order = np.argsort(segment, kind="stable")
        edges = np.searchsorted(segment[order], np.arange(m + 1))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)]
        subset = sums[edges[1:]] - sums[edges[:-1]]
        name = np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed
        held = np.diff(edges)
        # Of what two sets in reach share, more than ``spare`` counts; if a set's thin segments do not
        # count for that much, it shares one that is not thin, and what is found there is not empty.
        thin = np.count_nonzero(held[: band.exact] == 0) + 2 * np.count_nonzero(held[band.exact :] <= 1)
        whole = thin > band.spare
        out.append(_mix(subset ^ name)[whole | (held > 0)])
        if band.loose:
            # The last segments are the loose ones; their subsets less one shingle are looked up too.
            mine = order[edges[band.exact] :]
            mine = mine[whole | (held[segment[mine]] > 1)]
            out.append(_mix((subset[segment[mine]] - value[mine]) ^ name[segment[mine]]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


#: Bits of a parity sketch: so many for each shingle two sets may differ in, within these limits.
PARITY_BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 20


def parity_sketch(hashes: np.ndarray, percent: int) -> bytes:
    """A bit array, each bit the parity of the shingles that fall on it.

    Where two arrays differ, a shingle differs: no more bits differ than
    shingles. An array of twice the length folds to one of half by xor.
    """
    bits = LEAST_BITS
    while bits < PARITY_BITS * most_different(len(hashes), percent) and bits < MOST_BITS:
        bits *= 2
    place = (_mix(hashes ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def in_reach(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """False only if sets of sizes n and m with these sketches cannot link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), max(len(x), len(y)) * 8
    least = min(len(x), len(y)) * 8
    while size > least:
        size //= 2
        mask = (1 << size) - 1
        if len(x) > len(y):
            a = (a >> size) ^ (a & mask)
        else:
            b = (b >> size) ^ (b & mask)
    return (a ^ b).bit_count() <= (n + m) * (100 - percent) // (100 + percent)


def similar_sets(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id, component_id, n_links.

    Words lie between ASCII white space, with A-Z in lower case. A set holds the
    distinct runs of ``width`` words; a shorter text is one run, a text without
    words or a null one has none and is linked with nothing. Sets link when
    100 * common >= percent * all. ``class_id`` is the smallest id with the same
    set, ``component_id`` the smallest id reached by links, ``n_links`` how
    many other classes the class links with, all counted; without ``count_links`` there
    is no such column.

    Rows without an id are returned with no class or component and link with
    nothing. Rows that repeat an id are rows of their own, but one node. Other
    columns are ignored.
    """
    sets = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = sets.schema["_id"].dataType.simpleString()
    digests = stored(in_workers(sets, _digest_rows(width, percent), f"_id {kind}, n_shingles long, _d1 long, _d2 long, _parity binary"))
    classes = digests.where("n_shingles > 0 AND _id IS NOT NULL").groupBy("_d1", "_d2", "n_shingles").agg(F.min("_id").alias("class_id"))
    classes = stored(classes)

    band = F.floor(F.ln("n_shingles") / math.log(BAND_RATIO) + 1e-9).cast("int")
    counts = {r["b"]: r["n"] for r in classes.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()}
    bands = plan_bands(counts, percent)
    copies = digests.where("n_shingles > 0").join(classes, ["_d1", "_d2", "n_shingles"]).where("_id <> class_id").select("_id").distinct()
    sketches = digests.where("n_shingles > 0 AND _id IS NOT NULL").select("_id", F.col("n_shingles").alias("_n"), "_parity")
    parts = _components(sets, sketches, stored(copies.join(classes.select(F.col("class_id").alias("_id")), "_id", "left_anti")), bands, width, percent, kind)
    # One row per class that has a link, and the smallest id of its component.
    least = parts.groupBy("component").agg(F.min("node").alias("component_id"))
    linked = stored(parts.join(least, "component").select(F.col("node").alias("class_id"), "component_id"))
    if count_links:
        linked = linked.join(_link_counts(linked, sets, width, percent, kind), "class_id", "left")
    named = stored(classes.join(linked, "class_id", "left"))
    out = digests.drop("_parity").alias("d").join(named.alias("c"), ["_d1", "_d2", "n_shingles"], "left")
    own = F.when(F.col("d._id").isNotNull(), F.coalesce("component_id", "class_id", "d._id"))
    return out.select(
        F.col("d._id").alias(id_col), "n_shingles",
        F.when(F.col("d._id").isNotNull(), F.coalesce("class_id", "d._id")).alias("class_id"),
        own.alias("component_id"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []),
    )


def _digest_rows(width: int, percent: int):
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, d1, d2, parity = [], [], [], []
            # One text at a time: a worker should not keep a batch of them as objects.
            for text in batch.column(1):
                h = hashed_shingles(words_of(text.as_py()), width, known)
                n.append(len(h))
                d1.append(_mix(h).sum(dtype=np.uint64))
                d2.append(_mix(h ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
                parity.append(parity_sketch(h, percent))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_long(d1), as_long(d2), pa.array(parity, pa.binary())], ["_id", "n_shingles", "_d1", "_d2", "_parity"])

    return digest


def _signature_rows(width: int, bands: list[Band], percent: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                found = [signatures(hashed_shingles(words_of(t.as_py()), width, known), bands, percent) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["_id", "_sigs"])

    return sign


#: Members up to which a group's pairs are listed; larger groups are compared in tiles of about so many sets.
LISTED, TILE = 48, 256


def _components(sets: DataFrame, sketches: DataFrame, copies: DataFrame, bands: list[Band], width: int, percent: int, kind: str) -> DataFrame:
    """The components (node, component) that links between classes, named by their smallest ids, make.

    Sets that meet in a signature are a group, and its smallest id is the head.
    First all members are compared with their head: one comparison a member,
    which settles groups of copies. Two members that meet share a head, so what
    is left are pairs of members of one head that are in different components.
    Where a head has few members they are listed; where it has many, those in
    reach of another are compared in tiles, which give one link for each two
    components they connect. Texts are moved only for sets in reach.
    """
    signed = in_workers(sets.where("_id IS NOT NULL"), _signature_rows(width, bands, percent), f"_id {kind}, _sigs array<long>")
    # One list per class; an id that is repeated may have several, which does no harm. Copies are mostly
    # fewer than classes, so they are what is taken out.
    rows = join_narrow(signed, copies, ["_id"], "left_anti").select(F.explode("_sigs").alias("_sig"), "_id")
    # Signatures are shuffled once. Of a sorted partition the groups are read off as it streams by.
    placed = rows.repartition("_sig").sortWithinPartitions("_sig", "_id")
    groups = stored(in_workers(placed, _groups_of(kind), f"_sig long, _h {kind}, _id {kind}"))
    pairs = stored(groups.select(F.col("_h").alias("a"), F.col("_id").alias("b")).distinct())
    links = stored(_verified(stored(_in_reach(pairs, sketches, percent)), sets, width, percent))
    parts = connected_components(links)

    part = parts.select(F.col("node").alias("b"), F.col("component").alias("_part"))
    members = stored(pairs.join(part, "b", "left").select("a", "b", F.coalesce("_part", "b").alias("_part")))
    found = members.groupBy("a").agg(F.count("*").alias("_n"), F.min("_part").alias("_x"), F.max("_part").alias("_y"))
    open_ = stored(found.where("_x <> _y").select("a", "_n"))
    if open_.isEmpty():
        return parts
    few = open_.where(F.col("_n") <= LISTED).select(F.col("a").alias("_h"))
    listed = groups.join(few, "_h").join(members.select(F.col("a").alias("_h"), F.col("b").alias("_id"), "_part"), ["_h", "_id"])
    one, other = listed.select("_sig", F.col("_id").alias("a"), F.col("_part").alias("_p")), listed.select("_sig", F.col("_id").alias("b"), F.col("_part").alias("_q"))
    near = one.join(other, "_sig").where("a < b AND _p <> _q").select("a", "b").distinct()
    near = _in_reach(stored(near), sketches, percent)
    tiled = _tiles(_with_partners(members.join(open_.where(F.col("_n") > LISTED), "a"), sketches, percent, kind), sets, width, percent, kind)
    more = stored(near.unionByName(tiled).distinct())
    links = links.unionByName(stored(_verified(more, sets, width, percent)))
    return connected_components(links)


def _groups_of(kind: str):
    """From rows sorted by _sig and _id: _sig, the first _id, and each further one. A group may go on in the next batch."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, head = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs, ids = batch.column(0).to_numpy(), batch.column(1)
            begins = np.append(sigs[0] != sig, sigs[1:] != sigs[:-1])
            place = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            # The head of a group that began earlier is carried over: it stands behind the ids of this batch.
            pool = pa.concat_arrays([ids, pa.array([head], ids.type)])
            heads = pool.take(pa.array(np.where(place < 0, n, place)))
            sig, head = sigs[-1], heads[n - 1].as_py()
            out = pa.RecordBatch.from_arrays([batch.column(0), heads, ids], ["_sig", "_h", "_id"])
            # An id that stands twice in a group is not its own partner.
            yield out.filter(pc.and_(pa.array(~begins), pc.not_equal(heads, ids)))

    return groups


def _in_reach(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow a link."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in "ab"}
    side = lambda c, n: sketches.select(F.col("_id").alias(c), F.struct("_n", "_parity").alias(n))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(i).field(j).to_pylist() for i in (2, 3) for j in (0, 1)))
            near = [in_reach(n, m, x, y, percent) for n, x, m, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y")
    return in_workers(both, keep, f"a {kinds['a']}, b {kinds['b']}").distinct()


def _with_partners(members: DataFrame, sketches: DataFrame, percent: int, kind: str) -> DataFrame:
    """The members (a, b, _part, _n) that may link with one of the same head in another component.

    Blocks of sketches of a head's members are compared two by two.
    """
    blocks = F.ceil(F.col("_n") / TILE).cast("int")
    known = members.join(sketches.select(F.col("_id").alias("b"), F.col("_n").alias("_s"), "_parity"), "b")
    dealt = known.withColumn("_blocks", blocks).withColumn("_i", F.pmod(F.xxhash64("b"), F.col("_blocks")).cast("int"))
    held = stored(dealt.groupBy("a", "_i").agg(F.first("_blocks").alias("_blocks"), F.collect_list(F.struct("b", "_part", "_s", "_parity")).alias("_m")))
    each = held.select("a", "_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j")).where("_i <= _j")
    left, right = held.select("a", "_i", F.col("_m").alias("_l")), held.select("a", F.col("_i").alias("_j"), F.col("_m").alias("_r"))

    def hopeful(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                l, r = batch.column(1)[row].values, batch.column(2)[row].values
                i, j = np.nonzero(_reach_matrix(l, r, percent))
                found = pa.concat_arrays([l.field(0).take(pa.array(np.unique(i))), r.field(0).take(pa.array(np.unique(j)))]).unique()
                heads = pa.array([batch.column(0)[row].as_py()] * len(found), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([heads, found], ["a", "b"])

    pairs = each.join(left, ["a", "_i"]).join(right, ["a", "_j"]).select("a", "_l", "_r")
    near = stored(in_workers(pairs, hopeful, f"a {kind}, b {kind}").distinct())
    left_over = members.drop("_n").join(near, ["a", "b"])
    sizes = near.groupBy("a").agg(F.count("*").alias("_n"))
    return stored(left_over.join(sizes, "a"))


def _reach_matrix(left: pa.StructArray, right: pa.StructArray, percent: int) -> np.ndarray:
    """Which members of two blocks may link, a row for each left and a column for each right one."""
    part = pa.concat_arrays([left.field(1), right.field(1)]).dictionary_encode().indices.to_numpy()
    p, q = part[: len(left)], part[len(left) :]
    s, t = (np.asarray(side.field(2)).astype(np.int64) for side in (left, right))
    small, large = np.minimum(s[:, None], t[None, :]), np.maximum(s[:, None], t[None, :])
    near = (p[:, None] != q[None, :]) & (100 * small >= percent * large)
    if not near.any():
        return near
    sketches = [side.field(3).to_pylist() for side in (left, right)]
    bytes_ = min(len(x) for side in sketches for x in side)
    bits = [np.stack([_folded(x, bytes_) for x in side]) for side in sketches]
    allowed = (s[:, None] + t[None, :]) * (100 - percent) // (100 + percent)
    for i in range(len(left)):
        at = np.flatnonzero(near[i])
        if len(at):
            near[i, at] = np.bitwise_count(bits[0][i] ^ bits[1][at]).sum(axis=1, dtype=np.int64) <= allowed[i, at]
    return near


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.uint64)


def _link_counts(linked: DataFrame, sets: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """class_id, n_links: all links of each class, which lie within its component, by hashes of the shingles.

    Two classes that are a component link once. Larger components are compared
    in tiles, each pair of blocks a row of its own that returns one number per
    member, so no pair is emitted.
    """
    sizes = stored(linked.groupBy("component_id").agg(F.count("*").alias("_n")))
    sized = stored(join_narrow(linked, sizes, ["component_id"], "inner"))
    two = sized.where("_n = 2").select("class_id", F.lit(1).cast("long").alias("n_links"))
    if sized.where("_n > 2").limit(1).isEmpty():
        return two
    members = sized.where("_n > 2").select(F.col("component_id").alias("a"), F.col("class_id").alias("b"), F.col("class_id").alias("_part"), "_n")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _counted(batch.column(0)[row].values, batch.column(1)[row].values, percent)

    parts = in_workers(_block_pairs(members, sets, width, kind), count, f"class_id {kind}, n long")
    return two.unionByName(parts.groupBy("class_id").agg(F.sum("n").alias("n_links")))


def _texts_of(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """_id, _text of the written distinct ids."""
    texts = sets.where("_id IS NOT NULL")
    return texts.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "_id", "left_semi")


def _both_texts(pairs: DataFrame, sets: DataFrame, one_left: bool = False) -> DataFrame:
    """The pairs with both texts, sorted by a: a set that many are compared with is built once."""
    texts = stored(_texts_of(stored(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()), sets))
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_x"))
    if one_left:
        # Of an id with several texts one is what all members are compared with.
        heads = stored(pairs.select("a").distinct())
        left = join_narrow(left, heads, ["a"], "left_semi").groupBy("a").agg(F.max("_x").alias("_x"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_y"))
    return pairs.join(right, "b").join(left, "a")


def _verified(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link, decided on the words themselves."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in "ab"}

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                x = x.as_py()
                if last != (a, x):
                    last, held = (a, x), shingles(words_of(x), width)
                other = shingles(words_of(y.as_py()), width)
                # Sizes too far apart need no comparison.
                near = 100 * min(len(held), len(other)) >= percent * max(len(held), len(other))
                common = len(held & other) if near else 0
                keep.append(near and 100 * common >= percent * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _both_texts(pairs, sets).select("a", "b", "_x", "_y")
    return in_workers(both, compare, f"a {kinds['a']}, b {kinds['b']}").distinct()


def _tiles(members: DataFrame, sets: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """a, b: for each two components of a head's members that a tile connects, one pair that does, by hashes."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = _connecting(batch.column(0)[row].values, batch.column(1)[row].values, percent)
                if found is not None:
                    yield found

    return in_workers(_block_pairs(members, sets, width, kind), meet, f"a {kind}, b {kind}").distinct()


def _block_pairs(members: DataFrame, sets: DataFrame, width: int, kind: str) -> DataFrame:
    """_l, _r: each two blocks of a head's members, from a, b, _part and their number _n.

    A member is carried as what it and its head do not share, which is little for
    copies: of two members, what they do not share follows from that. A head's
    members are dealt to blocks, and each two blocks are a row of their own, so
    a large group is as many rows of equal size, and no pair is emitted that
    connects nothing new.
    """
    def unlike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, head = WordHashes(), None, None
        for batch in batches:
            sizes, deltas = [], []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5)):
                x = x.as_py()
                if last != (a, x):
                    last, head = (a, x), hashed_shingles(words_of(x), width, known)
                own = hashed_shingles(words_of(y.as_py()), width, known)
                sizes.append(len(own))
                deltas.append(np.setxor1d(head, own, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(sizes, pa.int64()), pa.array(deltas, pa.list_(pa.int64()))], ["a", "b", "_part", "_blocks", "_s", "_d"])

    blocks = F.ceil(F.col("_n") / TILE).cast("int").alias("_blocks")
    texts = _both_texts(stored(members.select("a", "b", "_part", blocks)), sets, one_left=True).select("a", "b", "_part", "_blocks", "_x", "_y")
    carried = in_workers(texts, unlike, f"a {kind}, b {kind}, _part {kind}, _blocks int, _s long, _d array<long>")
    block = F.pmod(F.xxhash64("b"), F.col("_blocks")).cast("int")
    held = carried.groupBy("a", block.alias("_i")).agg(F.first("_blocks").alias("_blocks"), F.collect_list(F.struct("b", "_part", "_s", "_d")).alias("_m"))
    held = stored(held)
    each = held.select("a", "_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j")).where("_i <= _j")
    left, right = held.select("a", "_i", F.col("_m").alias("_l")), held.select("a", F.col("_i").alias("_j"), F.col("_m").alias("_r"))
    return each.join(left, ["a", "_i"]).join(right, ["a", "_j"]).select("_l", "_r")


def _linking(left: pa.StructArray, right: pa.StructArray, percent: int) -> np.ndarray:
    """Which members of two blocks of one head link, a row for each left and a column for each right one."""
    sizes, deltas = zip(*[[side.field(i) for i in (2, 3)] for side in (left, right)])
    flat = [np.asarray(d.flatten()) for d in deltas]
    counts = [np.asarray(d.value_lengths()) for d in deltas]
    _, place = np.unique(np.concatenate(flat), return_inverse=True)
    at = [place[: len(flat[0])], place[len(flat[0]) :]]
    owner = [np.repeat(np.arange(len(c)), c) for c in counts]
    shared = np.zeros((len(left), len(right)), np.float32)
    # The product of two 0/1 matrices, some thousand shingles at a time.
    for begin in range(0, int(place.max()) + 1 if len(place) else 0, 8192):
        sides = []
        for k, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, 8192), np.float32)
            here = (at[k] >= begin) & (at[k] < begin + 8192)
            m[owner[k][here], at[k][here] - begin] = 1.0
            sides.append(m)
        shared += sides[0] @ sides[1].T
    s, t = (np.asarray(x).astype(np.int64) for x in sizes)
    unlike = counts[0][:, None] + counts[1][None, :] - 2 * shared.astype(np.int64)
    common = (s[:, None] + t[None, :] - unlike) // 2
    return 100 * common >= percent * (s[:, None] + t[None, :] - common)


def _counted(left: pa.StructArray, right: pa.StructArray, percent: int) -> pa.RecordBatch:
    """How many of the other block each member of two blocks links with; a block with itself counts once.

    An id with several texts is one member, which links as any of them does.
    """
    codes, ids = [], []
    for side in (left, right):
        own = side.field(0).dictionary_encode()
        codes.append(own.indices.to_numpy())
        ids.append(own.dictionary)
    link = np.zeros((len(ids[0]), len(ids[1])), bool)
    i, j = np.nonzero(_linking(left, right, percent))
    link[codes[0][i], codes[1][j]] = True
    if ids[0].equals(ids[1]):
        np.fill_diagonal(link, False)
        return pa.RecordBatch.from_arrays([ids[0], pa.array(link.sum(1), pa.int64())], ["class_id", "n"])
    both = [pa.array(link.sum(axis), pa.int64()) for axis in (1, 0)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(both)], ["class_id", "n"])


def _connecting(left: pa.StructArray, right: pa.StructArray, percent: int) -> pa.RecordBatch | None:
    """One linking pair of each two components of two blocks of members of one head."""
    ids, parts = zip(*[[side.field(i) for i in range(2)] for side in (left, right)])
    code = pa.concat_arrays(parts).dictionary_encode().indices.to_numpy()
    p, q = code[: len(left)], code[len(left) :]
    i, j = np.nonzero(_linking(left, right, percent) & (p[:, None] != q[None, :]))
    if not len(i):
        return None
    both = np.minimum(p[i], q[j]).astype(np.int64) * (int(code.max()) + 1) + np.maximum(p[i], q[j])
    _, one = np.unique(both, return_index=True)
    return pa.RecordBatch.from_arrays([ids[0].take(pa.array(i[one])), ids[1].take(pa.array(j[one]))], ["a", "b"])


def drop_near_copies(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component.

    Rows without an id or words stay. Rows that share an id stay or go together.
    """
    found = similar_sets(docs, width, percent, id_col, text_col, count_links=False)
    gone = stored(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct())
    return join_narrow(docs, gone, [id_col], "left_anti").select(*docs.columns)


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark, sf):
    return similar_sets(table(spark, sf, "documents"))
