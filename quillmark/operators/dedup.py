"""Duplicates: perceptual hashes by banded Hamming joins, fuzzy text by complete bounds on grams and common subsequences, quarantine sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ahash(values: Column) -> Column:
    """64 bits of a vector of 64 numbers, first the highest: whether each is above the mean."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.transform(values, lambda x: F.when(x.cast("double") * n > total, "1").otherwise("0"))


def bits_of(text: Column) -> Column:
    """A string of 64 zeros and ones as a long; null for anything else."""
    half = lambda a: F.conv(F.substring(text, a, 32), 2, 10).cast("long")
    return F.when(text.rlike("^[01]{64}$"), F.shiftleft(half(1), 32).bitwiseOR(half(33)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 999 where either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int = 3) -> DataFrame:
    """(key_a, key_b, distance) with key_a < key_b and distance <= most; null hashes take no part.

    Pigeonhole: with most + 1 bands at least one is equal. Keys of one hash are handled as a group: distinct hashes are
    joined, then their members; a pair is kept by its first equal band only, so no distinct is needed.
    """
    bands = most + 1
    width = 64 // bands
    hashes = df.dropna(subset=[key, bits]).select(F.col(bits).alias("h")).distinct()
    band = lambda h, i: F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit((1 << (width if i < bands - 1 else 64 - width * (bands - 1))) - 1))
    parts = hashes.select("h", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(F.col("h"), i).alias("v")) for i in range(bands)])).alias("b")).select("h", "b.i", "b.v")
    pairs = parts.withColumnRenamed("h", "ha").join(parts.withColumnRenamed("h", "hb"), ["i", "v"]).where("ha < hb")
    x = F.col("ha").bitwiseXOR(F.col("hb"))
    earlier = F.lit(False)
    for i in range(bands):
        earlier = earlier | ((F.lit(i) < F.col("i")) & (band(x, i) == 0))
    pairs = pairs.where(F.bit_count(x) <= most).where(~earlier).select("ha", "hb", F.bit_count(x).alias("distance"))
    rows = df.dropna(subset=[key, bits]).select(F.col(key).alias("k"), F.col(bits).alias("h"))
    same = rows.withColumnRenamed("k", "ka").join(rows.withColumnRenamed("k", "kb"), "h").where("ka < kb").select("ka", "kb", F.lit(0).alias("distance"))
    other = pairs.join(rows.select(F.col("h").alias("ha"), F.col("k").alias("ka")), "ha").join(rows.select(F.col("h").alias("hb"), F.col("k").alias("kb")), "hb").where("ka <> kb")
    other = other.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), "distance")
    return same.unionByName(other).withColumnsRenamed({"ka": "key_a", "kb": "key_b"})


#: Texts of a block, at most about; more than SPLIT of them, or than ALIKE where most are alike, are split further, so that small tables have tasks for all cores.
BLOCK, SPLIT, ALIKE = 1 << 17, 4096, 256
#: Bits of a text's sketch, those of them that frequent grams have to themselves, and buckets in which grams are counted; pairs compared at once, and pairs that wait for the finer bounds.
BITS, OWN, GRAMS, TILE, WAITING = 1024, 768, 1 << 16, 1 << 14, 1 << 20
#: Characters are told apart within a script, as its letters are neighbours; difflib treats texts from AUTOJUNK characters in another way.
KINDS, AUTOJUNK = 128, 200


def _codes(texts) -> tuple:
    """(code points of all texts, offsets) of an Arrow array of strings."""
    import numpy as np

    texts = texts.to_pylist()
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum([0, *map(len, texts)])


def _numbered_grams(flat, off, q: int):
    """(row, code or hash of 32 bits, number among the equal ones of its text, size of the run of equal ones at its first, else 0) of all grams of q characters."""
    import numpy as np

    n = np.diff(off)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = flat.astype(np.uint64)
    if q > 1:
        pair = (key[:-1] * np.uint64(2654435761) + key[1:]) * np.uint64(0x9E3779B97F4A7C15)
        key, row = (pair >> np.uint64(32))[row[:-1] == row[1:]], row[:-1][row[:-1] == row[1:]]
    key = np.sort(row << np.uint64(32) | key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[first, len(key)])
    size = np.zeros(len(key), np.int64)
    size[first] = runs
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF), np.arange(len(key)) - np.repeat(first, runs), size


def _bucket(gram, number):
    import numpy as np

    return ((((gram + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


class Sketches:
    """Lengths, and sketches of the numbered characters and pairs of characters of texts, rows of all in one order.

    A gram toggles a bit, so two sketches differ in no more bits than the bags of grams do, whichever bits are chosen;
    grams that are frequent in `tuned` have bits of their own, for few differences to cancel out.
    """

    CHUNK = 2048

    def __init__(self, texts, bits: dict | None = None):
        import numpy as np

        self.bits = bits or {q: self._tuned(texts, q) for q in (1, 2)}
        n = len(texts)
        self.length, self.rare, self.foreign = (np.zeros(n, np.int64) for _ in range(3))
        self.full = {q: np.zeros((n, BITS // 64), np.uint64) for q in (1, 2)}
        kinds = []
        for at in range(0, n, self.CHUNK):
            flat, off = _codes(texts.slice(at, self.CHUNK))
            m = len(off) - 1
            self.length[at : at + m] = np.diff(off)
            kinds.append((flat % KINDS).astype(np.uint8))
            self.foreign[at : at + m] = np.diff(np.r_[0, np.cumsum(flat > 0x24F)][off])
            for q, own in self.bits.items():
                row, gram, number, size = _numbered_grams(flat, off, q)
                toggled = np.bincount(row * BITS + own[_bucket(gram, number)], minlength=m * BITS) & 1
                self.full[q][at : at + m] = np.packbits(toggled.astype(bool).reshape(m, BITS), axis=1).view(np.uint64)
                if q == 1:
                    unpopular = np.where(size <= np.diff(off)[row] // 100 + 1, size, 0)
                    self.rare[at : at + m] = np.bincount(row, unpopular, m)
        self.kinds, self.places = np.concatenate([np.zeros(0, np.uint8), *kinds]), np.cumsum(self.length) - self.length
        # texts in which difflib takes any character as a start have no bound by their rare ones
        self.rare[self.length < AUTOJUNK] = np.iinfo(np.int32).max
        share = self.foreign / np.maximum(self.length, 1)
        self.part = (self.length >= AUTOJUNK) * 3 + (share > 0.25) + (share >= 0.75)
        self.order = np.lexsort((np.arange(n), self.length, self.part))
        for k in ("length", "rare", "part", "places"):
            setattr(self, k, getattr(self, k)[self.order])
        self.full = {q: x[self.order] for q, x in self.full.items()}
        # halves laid upon each other are sketches, too; one word of all texts after the other
        self.half = {q: np.ascontiguousarray((x[:, : BITS // 128] ^ x[:, BITS // 128 :]).T) for q, x in self.full.items()}
        self.starts = np.searchsorted(self.part, np.arange(7))

    def spelled(self, rows):
        """(kinds of characters of the texts of these rows, offsets)."""
        import numpy as np

        n = self.length[rows]
        off = np.cumsum(np.r_[0, n])
        return self.kinds[np.repeat(self.places[rows] - off[:-1], n) + np.arange(off[-1])], off

    @staticmethod
    def _tuned(texts, q: int):
        """The bit of each bucket of numbered grams; only the speed depends on the texts that are looked at for it."""
        import numpy as np

        some = texts.take(np.unique(np.linspace(0, len(texts) - 1, 4096).astype(np.int64))) if len(texts) else texts
        _, gram, number, _ = _numbered_grams(*_codes(some), q)
        ranked = np.argsort(-np.bincount(_bucket(gram, number), minlength=GRAMS), kind="stable")
        bit = OWN + np.arange(GRAMS) % (BITS - OWN)
        bit[ranked[:OWN]] = np.arange(OWN)
        return bit


def matched(x, xo, y, yo, left):
    """Which pairs k of texts x[xo[k]:xo[k + 1]], y[yo[k]:yo[k + 1]] (kinds of characters) can have a common subsequence that leaves `left[k]` characters over at most.

    Bit-parallel longest common subsequence (Hyyrö) for all pairs at once, in the band of places that so few insertions
    and deletions can shift to each other. A pair ends early where y's beginning has more unmatched characters than allowed.
    """
    import numpy as np

    n, nx, ny = len(left), np.diff(xo), np.diff(yo)
    # characters of each text that may be unmatched; the band of a step begins at its own bit, and so has `drop` bits before the first character
    cut, drop = (left + nx - ny) // 2, (left - nx + ny) // 2
    alive = np.flatnonzero((cut >= 0) & (drop >= 0))
    words = int(left.max(initial=0)) // 64 + 1
    row = np.repeat(np.arange(n), nx)
    place = np.arange(len(x)) - np.repeat(xo[:-1] - np.maximum(drop, 0), nx)
    steps = np.full((int(ny.max(initial=0)), n), KINDS, np.int64)
    steps[np.arange(len(y)) - np.repeat(yo[:-1], ny), np.repeat(np.arange(n), ny)] = y
    steps += np.arange(n) * (KINDS + 1)
    match = np.zeros((max(int(place.max(initial=0)), len(steps)) // 64 + words + 2, n * (KINDS + 1)), np.uint64)
    np.add.at(match.reshape(-1), (place >> 6) * match.shape[1] + row * (KINDS + 1) + x, np.uint64(1) << (place & 63).astype(np.uint64))
    one, top = np.uint64(1), np.uint64(63)
    v, out, steps = np.full((words, len(alive)), ~np.uint64(0)), np.zeros(len(alive), np.uint64), steps[:, alive]
    ended = []
    for t in range(len(steps)):
        if t:
            out += ~v[0] & one
            for w in range(words):
                v[w] >>= one
                v[w] |= v[w + 1] << top if w + 1 < words else one << top
        at, shift, carry = t >> 6, np.uint64(t & 63), None
        here = match[at].take(steps[t])
        for w in range(words):
            m = here >> shift
            if shift or w + 1 < words:
                here = match[at + w + 1].take(steps[t])
            if shift:
                m |= here << (np.uint64(64) - shift)
            old = v[w]
            both = old & m
            total = old + both
            if words > 1:
                over = total < old
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            # old without m
            v[w] = total | (old ^ both)
        if t % 16 == 15:
            ok = t + 1 - out.astype(np.int64) - np.bitwise_count(~v).sum(0, dtype=np.int64) <= drop[alive] + np.maximum(0, t + 1 - ny[alive])
            if ok.sum() < 0.8 * len(ok):
                alive, v, out, steps = alive[ok], np.ascontiguousarray(v[:, ok]), out[ok], np.ascontiguousarray(steps[:, ok])
                if not len(alive):
                    break
    common = out.astype(np.int64) + np.bitwise_count(~v).sum(0, dtype=np.int64)
    return alive[nx[alive] + ny[alive] - 2 * common <= left[alive]]


def near_texts(texts, others, least: float, mutual: bool = False, same: bool = False):
    """Yields arrays (i, j) of all texts[i] and others[j] (Arrow arrays) that can have a matching-blocks ratio of at least `least` (a superset); where both are the same texts, each pair once.

    Matching blocks are a common subsequence of M characters, so left = l1 + l2 - 2M <= (1 - least)(l1 + l2) characters are
    left over. k blocks have M - k(q - 1) common grams of q characters at least, so the bags of grams differ in
    left + 2(q - 1)(k - 1) at most. There are left + 1 blocks at most. If difflib ignores popular characters of the second
    text, every block but one at the beginning of both has a character that is none: k - 1 is at most their number. With
    `mutual` either text can be the second. First sketches are compared, then the longest common subsequence.
    """
    import numpy as np

    if not len(texts) or not len(others):
        return
    b = Sketches(others)
    a = b if same else Sketches(texts, b.bits)
    left = lambda i, j: (1 - least) * (a.length[i] + b.length[j]) + 1e-6
    blocks = lambda i, j: np.maximum(a.rare[i], b.rare[j]) if mutual else b.rare[j]

    def finer(i, j):
        for q in (1, 2):
            kept, clear = [], []
            for at in range(0, len(i), TILE):
                x, y = i[at : at + TILE], j[at : at + TILE]
                rest = left(x, y)
                differ = np.bitwise_count(a.full[q][x] ^ b.full[q][y]).sum(1, dtype=np.int64)
                kept.append(at + np.flatnonzero(differ <= rest + 2 * (q - 1) * np.minimum(rest, blocks(x, y))))
                clear.append(differ[kept[-1] - at] <= rest[kept[-1] - at])
            kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            i, j = i[kept], j[kept]
        # pairs whose bags of pairs are so near need no look at the subsequence, which would only drop pairs
        clear = np.concatenate(clear) if clear else np.zeros(0, bool)
        if clear.any():
            yield a.order[i[clear]], b.order[j[clear]]
            i, j = i[~clear], j[~clear]
        by = np.lexsort((a.length[i], b.length[j]))
        i, j, at = i[by], j[by], 0
        while at < len(i):
            # tables of bounded size
            size = max(16, (1 << 20) // ((KINDS + 1) * (int(a.length[i[at : at + 8192]].max()) // 64 + 3)))
            x, y = i[at : at + size], j[at : at + size]
            ok = matched(*a.spelled(x), *b.spelled(y), np.floor(left(x, y)).astype(np.int64))
            yield a.order[x[ok]], b.order[y[ok]]
            at += size

    met, waiting, room = [], 0, [np.empty(TILE, t) for t in (np.uint64, np.uint8, np.uint8, np.uint16)]
    longer = (2 - least) / least
    for part in range(6):
        for other in range(6):
            # letters of other scripts are characters that differ
            if abs(part % 3 - other % 3) == 2 and 0.75 - 0.25 * longer > (1 - least) * (1 + longer):
                continue
            q = 2 if part >= 3 and other >= 3 else 1
            ends = b.starts[other : other + 2]
            at, end = a.starts[part : part + 2]
            lengths = b.length[ends[0] : ends[1]]
            while at < end:
                first = ends[0] + np.searchsorted(lengths, a.length[at] / longer - 1e-6)
                if same:
                    first = max(first, at + 1)
                last = ends[0] + np.searchsorted(lengths, a.length[at] * longer + 1e-6, side="right")
                upto = min(end, at + max(1, min(1024, TILE // max(1, last - first))))
                last = ends[0] + np.searchsorted(lengths, a.length[upto - 1] * longer + 1e-6, side="right")
                wide = max(1, TILE // (upto - at))
                for lo in range(first, last, wide):
                    x, y = np.arange(at, upto), slice(lo, min(last, lo + wide))
                    size = len(x), y.stop - y.start
                    n = size[0] * size[1]
                    xor, ones, some, differ = (r[:n].reshape(size) for r in room)
                    differ.fill(0)
                    for w, (s, t) in enumerate(zip(a.half[q][:, at:upto], b.half[q][:, y])):
                        np.bitwise_xor(s[:, None], t, out=xor)
                        np.bitwise_count(xor, out=ones if w % 2 else some)
                        # two words have 128 bits at most
                        if w % 2:
                            np.add(some, ones, out=some)
                            np.add(differ, some, out=differ)
                    # bounds of the whole tile first; rows and pairs of their own come after
                    rest = (1 - least) * (a.length[x].max() + b.length[y]) + 1e-6
                    if q == 2:
                        rest = rest + 2 * np.minimum(rest, np.maximum(a.rare[x].max(), b.rare[y]) if mutual else b.rare[y])
                    at_most = np.minimum(rest, BITS).astype(np.uint16)
                    found = np.flatnonzero(differ <= at_most)
                    i, j = found // size[1] + at, found % size[1] + lo
                    if same:
                        i, j = i[j > i], j[j > i]
                    met.append((i, j))
                    waiting += len(i)
                    if waiting > WAITING:
                        yield from finer(*map(np.concatenate, zip(*met)))
                        met, waiting = [], 0
                at = upto
    if met:
        yield from finer(*map(np.concatenate, zip(*met)))


def fuzzy_matches(candidates: DataFrame, references: DataFrame, least: float = 0.85, shortest: int = 15, mutual: bool = False, once: bool = False) -> DataFrame:
    """(cand, ref, ratio) of all normalised texts whose matching-blocks ratio is at least `least`; both have `shortest` characters at least.

    candidates(cand, text), references(ref, text); best distinct texts. Texts meet in blocks of bounded size; `near_texts`
    then drops only pairs that its bounds exclude. Nothing is lost, and the work grows with the square of the texts, with
    few nanoseconds for a pair. With `mutual`, both sides are the same texts: each pair is looked at once, and given in
    both orders (the ratio depends on it). With `once`, too, it is given with cand < ref only (long keys), and as most of
    the texts may be alike, few of them are spread over the tasks already.
    """
    import math

    c = candidates.where(F.length("text") >= shortest).select("cand", "text")
    r = references.where(F.length("text") >= shortest).select("ref", "text")
    n = c.count()
    if mutual:
        nc = nr = max(math.ceil(n / BLOCK), 8 if once and n > ALIKE else 4 if n > SPLIT else 1)
    else:
        # a side is sent as often as the other has blocks
        nc, nr = (max(1, math.ceil(x / size)) for x, size in ((n, max(1, BLOCK // 8)), (r.count(), BLOCK)))
    block = lambda key, n: F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n)).cast("int")
    c = c.withColumn("i", block("cand", nc)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") if mutual else F.lit(nr - 1))))
    # a block that meets itself is there once
    r = r.withColumn("j", block("ref", nr)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    if mutual:
        r = r.where("j < i")

    # one table with both sides: keys as strings, so that long ones stay exact whatever is null
    sides = c.select("i", "j", F.lit(True).alias("left"), F.col("cand").cast("string").alias("id"), "text").unionByName(r.select("i", "j", F.lit(False).alias("left"), F.col("ref").cast("string").alias("id"), "text"))

    def meet(key, block):
        import difflib

        import pyarrow as pa

        _, i, j = (k.as_py() for k in key)
        itself = mutual and i == j
        one = block.filter(block.column("left")).select(["id", "text"])
        other = one if itself else block.filter(pa.compute.invert(block.column("left"))).select(["id", "text"])
        (ka, a), (kb, b) = ([pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.string()) for x in t.columns] for t in (one, other))
        out = []
        for x, y in near_texts(a, b, least, mutual, itself):
            for k, t, o, u in zip(ka.take(x).to_pylist(), a.take(x).to_pylist(), kb.take(y).to_pylist(), b.take(y).to_pylist()):
                orders = [(k, o, t, u)] if not mutual else [(k, o, t, u), (o, k, u, t)]
                for k, o, t, u in orders:
                    if (not once or int(k) < int(o)) and (r := difflib.SequenceMatcher(None, t, u).ratio()) >= least:
                        out.append((k, o, r))
        return pa.table({"cand": pa.array([o[0] for o in out], pa.string()), "ref": pa.array([o[1] for o in out], pa.string()), "ratio": pa.array([o[2] for o in out], pa.float64())})

    # a given number, which adaptive execution leaves as it is: a task for each group where both sides are the same, the larger ones first, else more than groups, so that few of them share a task
    slot, tasks = F.xxhash64("i", "j"), 4 * nc * nr
    if mutual:
        groups = sorted(((i, j) for i in range(nc) for j in range(i + 1)), key=lambda x: x[0] == x[1])
        tasks = len(groups)
        at = candidates.sparkSession.range(0, 64 * tasks, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).agg(F.min("id").alias("id")).toArrow().to_pydict()
        at = dict(zip(at["p"], at["id"]))
        slots = [0] * (nc * nc)
        for n, (i, j) in enumerate(groups):
            slots[i * nc + j] = at.get(n, n)
        slot = F.array(*[F.lit(x).cast("long") for x in slots])[F.col("i") * nc + F.col("j")]
    found = sides.withColumn("slot", slot).repartition(tasks, "slot").groupBy("slot", "i", "j").applyInArrow(meet, "cand string, ref string, ratio double")
    return found.select(F.col("cand").cast(candidates.schema["cand"].dataType), F.col("ref").cast(references.schema["ref"].dataType), "ratio")


def first_hit(hits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first collision of each candidate in the given order."""
    rest = [c for c in hits.columns if c != key]
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("x")
    return hits.groupBy(key).agg(best).select(key, *[F.col("x")[c].alias(c) for c in rest])


def exact_groups(df: DataFrame, key: str, digest: str) -> DataFrame:
    """(digest, n, first key) of every digest that occurs more than once."""
    return df.groupBy(digest).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
