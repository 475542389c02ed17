"""Problem 3: near-duplicate records, by the generalised pigeonhole principle on bags of words.

A text is the set of its words (a repeated word counts as often as it occurs). Two texts of s and l words share o of
them; 2o >= t(s+l) is the same as a Hamming distance of at most (1-t)(s+l) between their sets. The dimensions (words)
are grouped into m partitions, correlated words together. By the generalised pigeonhole principle a pair within
distance d has, for any thresholds t_i >= -1 with sum(t_i + 1) = d + 1, a partition with distance at most t_i there.
Each text, as the longer of a pair, allocates its thresholds (-1: not probed, 0: equal, 1: one word more or less) by
dynamic programming on estimated candidate counts, so no pair is lost. Candidates are verified on their whole word sets.

Signatures met by one text only cannot make a candidate; a first pass marks signatures in bitmaps, and only marked ones
are shuffled. The bitmaps never remove a signature that two texts share. Keys that very many texts have are found on a
part of the texts and split over several tasks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, newest, written
from .lookalike import form_of

NEAR, LEAST_WORDS = 0.82, 8
#: Bits of each of the four bitmaps of signatures: so many for each word of all texts, as a power of two within these bounds (32 MB each at most; fuller bitmaps keep more signatures and lose none).
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 20, 28
#: Buckets of the histogram of words.
HISTOGRAM = 1 << 18
#: Cells of the tables of costs that texts are allocated with at a time.
CELLS = 1 << 22
#: Index signatures of one key that a task gets on average; one text of so many is counted to find keys with more; such keys that are split at most.
HOT, COUNTED, SPLIT = 1 << 16, 64, 10_000
#: Keys with at most so many pairs are met many at once.
FEW = 1 << 12
#: Texts, at most, from which the correlation of frequent words is estimated, and the words looked at.
SAMPLE, FREQUENT = 4096, 256
CHUNK = 1 << 14
#: Bits of a hashed word: enough that no two words of two texts meet by chance, and fewer bytes to shuffle than 64 bits.
TOKEN, PACKED = (1 << 40) - 1, 5
#: Bits of the keys of signatures; keys that meet by chance only make a candidate more.
KEY_BITS = 46
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(31)
    a *= np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(29))


class Words:
    """Hashed words of batches of texts; one per Python task."""

    def __init__(self):
        import regex
        import xxhash

        self.find, self.plain = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall, re.compile("[a-z0-9]+").findall
        self.known: dict[str, int] = {}
        self.hash, self.whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest

    def __call__(self, texts: list[str | None]):
        """(sizes, sorted hashed words of all texts together, hash of each bag of words); size 0 for null texts and those under LEAST_WORDS words, which have no partner."""
        if len(self.known) > 500_000:
            self.known.clear()
        known, flat, sizes = self.known, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t and len(ws := self.plain(t.lower()) if t.isascii() else self.find(form_of(t).lower())) >= LEAST_WORDS:
                sizes[i] = len(ws)
                flat += ws
        for w in set(flat) - known.keys():
            known[w] = self.hash(w) & TOKEN
        tok = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        tok = tok[np.lexsort((tok, np.repeat(np.arange(len(texts)), sizes)))]
        ends = np.cumsum(sizes)
        raw = memoryview(tok).cast("B") if len(tok) else b""
        bags = [self.whole(raw[8 * (e - n) : 8 * e]) if n else None for n, e in zip(sizes.tolist(), ends.tolist())]
        return sizes, tok, bags


def with_words(records: DataFrame, text: str) -> DataFrame:
    """records with `tokens` (sorted hashes of the words of the text as a reader sees it, packed) and `hash` (of the whole bag) in place of the text.

    Words are lower-cased runs of letters, combining marks and digits. Null for null texts and for those under LEAST_WORDS words, which have no partner.
    """
    import pyarrow as pa

    rest = [c for c in records.columns if c not in (text, "tokens", "hash")]

    def run(it):
        words = Words()
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sizes, tok, bags = words(part.column(len(rest)).to_pylist())
                tokens = packed(sizes, tok)
                hashes = pa.array([h if h is None else h - (1 << 64) if h >> 63 else h for h in bags], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), hashes, tokens], names=[*rest, "hash", "tokens"])

    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in rest)
    return records.select(*rest, text).mapInArrow(run, f"{kinds}, hash long, tokens binary")


def packed(sizes: np.ndarray, tok: np.ndarray):
    """An Arrow array of binaries with PACKED bytes of each hashed word; null where the size is 0."""
    import pyarrow as pa

    raw = np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8)[:, :PACKED])
    ends = PACKED * np.r_[0, np.cumsum(sizes)]
    valid = np.packbits(sizes > 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(valid), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashed words) of an Arrow array of packed words."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].reshape(-1, PACKED)
    tok = np.zeros((len(raw), 8), np.uint8)
    tok[:, :PACKED] = raw
    return (off.astype(np.int64) - off[0]) // PACKED, tok.view(np.uint64).ravel()


def occurrence(tok: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each word came before in its row, for words sorted within rows."""
    start = np.r_[True, (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])] if len(tok) else np.zeros(0, bool)
    at = np.arange(len(tok))
    return (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)


def apart(tok: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Words of a set: a repeated word is another one each time."""
    return np.where(nth > 0, _mix(tok ^ (nth << np.uint64(48)), 3), tok)


def _sizes(near: float) -> list[int]:
    """Bounds of the classes of size: no text is in more than two classes as the shorter of a pair."""
    out = [LEAST_WORDS]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.floor(out[-1] * (2 - near) / near)))
    return out


class Scheme:
    """Partitions, thresholds and signatures of batches of texts; everything it holds has a fixed size."""

    def __init__(self, near: float, counts: np.ndarray, n_docs: int, group_of: dict[int, int]):
        self.near, self.counts, self.n_docs = near, counts, max(1, n_docs)
        self.bounds = np.array(_sizes(near))
        self.grouped = np.array(sorted(group_of), dtype=np.uint64)
        self.group = np.array([group_of[int(k)] for k in self.grouped], dtype=np.uint64)

    def parts(self, k: int) -> int:
        """Partitions of class k: enough that thresholds of at most 1 suffice for its longest texts, and one more."""
        most = math.floor(2 * (1 - self.near) * (self.bounds[k + 1] - 1) + 1e-9)
        return math.ceil((most + 1) / 2) + 1

    def klass(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def signatures(self, ids: np.ndarray, offsets: np.ndarray, tokens: np.ndarray):
        """Yields (role, keys, rows, own): role 0 of index signatures, 1 of probes; rows number the texts of the batch.

        own tells whether the text itself has the key in the other role, too (one value or one for each key).

        `sketch` is set to one parity sketch per text: each word turns one of 64 bits, so sketches differ in no more bits than sets in words.
        """
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(ids)), n)
        order = np.lexsort((tokens, row))
        tok = tokens[order].astype(np.uint64)
        nth, word = occurrence(tok, row), tok
        tok = apart(tok, nth)
        p = (self.counts[(word % np.uint64(HISTOGRAM)).astype(np.int64)].astype(float) / (1.0 + nth)).clip(1, self.n_docs) / self.n_docs
        self.sizes, self.sketch = n, np.zeros(len(ids), np.uint64)
        np.bitwise_xor.at(self.sketch, row, np.uint64(1) << (_mix(tok, 23) >> np.uint64(58)))
        place = np.searchsorted(self.grouped, word).clip(0, max(0, len(self.grouped) - 1))
        home = _mix(tok, 5)
        if len(self.grouped):
            home = np.where(self.grouped[place] == word, _mix(self.group[place], 7), home)
        own, longer = self.klass(n), self.klass(np.floor(n * (2 - self.near) / self.near + 1e-9).astype(np.int64))
        for k in np.unique(np.r_[own, longer]) if len(ids) else []:
            m = self.parts(int(k))
            docs = np.flatnonzero((own == k) | (longer == k))
            local = np.full(len(ids), -1)
            local[docs] = np.arange(len(docs))
            use = local[row] >= 0
            part = (home[use] % np.uint64(m)).astype(np.int64)
            cell = local[row[use]] * m + part
            value = _mix(tok[use], 11)
            by = np.argsort(cell, kind="stable")
            full = np.zeros(len(docs) * m, np.uint64)
            logs = np.zeros(len(docs) * m)
            cells, first = np.unique(cell[by], return_index=True)
            if len(cells):
                full[cells] = np.add.reduceat(value[by], first)
                logs[cells] = np.add.reduceat(np.log(p[use])[by], first)
            numbers = np.tile(np.arange(m, dtype=np.uint64), len(docs))
            whole = _mix(full + numbers * np.uint64(0x9E3779B97F4A7C15), 100 + int(k))
            less = _mix(full[cell] - value + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 100 + int(k))
            cell_doc, less_doc = np.repeat(docs, m), docs[cell // m]
            mine = own[docs] == k
            t = self._allocate(logs, p[use], cell, m, len(docs), np.floor(2 * (1 - self.near) * n[docs] + 1e-9).astype(np.int64), mine).ravel()
            one = t[cell] == 1
            yield 0, _mix(whole, 1), cell_doc, t >= 0
            yield 0, _mix(less, 2), less_doc, False
            yield 1, _mix(whole[t >= 0], 1), cell_doc[t >= 0], True
            yield 1, _mix(whole[t == 1], 2), cell_doc[t == 1], False
            yield 1, _mix(less[one], 1), less_doc[one], False

    def _allocate(self, logs, p, cell, m, docs, most, mine) -> np.ndarray:
        """Thresholds of each text's partitions: least estimated candidates with sum(t_i + 1) = distance + 1."""
        zero = np.exp(logs)
        drop = np.zeros(docs * m)
        np.add.at(drop, cell, np.exp(logs[cell]) / p)
        zero = (zero * self.n_docs).reshape(docs, m)
        one = (zero * 3 + drop.reshape(docs, m) * self.n_docs)
        zero, one = zero + 0.01, one + 0.05
        out = np.full((docs, m), -1, np.int8)
        at = np.flatnonzero(mine)
        if not len(at):
            return out
        need = most[at] + 1
        step = max(1, CELLS // (m * (int(need.max()) + 1)))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            out[some] = self._cheapest(zero[some], one[some], need[lo : lo + step])
        return out

    def _cheapest(self, zero: np.ndarray, one: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The dynamic program over the partitions of some texts.

        Of a long text the costs are kept at every root(m)-th partition only and the choices between them are found again on the way back, so even 100,000 words need a few MB.
        """
        n, m = zero.shape
        top = int(need.max())
        block = m if m * (top + 1) * n <= CELLS else math.isqrt(m) + 1
        out = np.full((n, m), -1, np.int8)

        def run(best, lo, hi, choice=None):
            for i in range(lo, hi):
                new = best.copy()
                for t, cost in ((0, zero), (1, one)):
                    if top >= t + 1:
                        via = best[:, : top - t] + cost[:, i][:, None]
                        better = via < new[:, t + 1 :]
                        new[:, t + 1 :][better] = via[better]
                        if choice is not None:
                            choice[i - lo][:, t + 1 :][better] = t
                best = new
            return best

        best = np.full((n, top + 1), np.inf)
        best[:, 0] = 0
        kept = []
        for lo in range(0, m, block):
            kept.append((lo, best))
            if lo + block < m:
                best = run(best, lo, lo + block)
        left, rows = need.copy(), np.arange(n)
        for lo, best in reversed(kept):
            hi = min(m, lo + block)
            choice = np.full((hi - lo, n, top + 1), -1, np.int8)
            run(best, lo, hi, choice)
            for i in range(hi - 1, lo - 1, -1):
                t = choice[i - lo][rows, left]
                out[:, i] = t
                left = left - (t.astype(np.int64) + 1)
        return out


def _correlated(sample: list[np.ndarray]) -> dict[int, int]:
    """Groups of frequent words that occur together: each word joins the more frequent word it correlates with most."""
    if len(sample) < 64:
        return {}
    sets = [np.unique(x.astype(np.uint64)) for x in sample]
    flat = np.concatenate(sets)
    vals, cnt = np.unique(flat, return_counts=True)
    top = vals[np.argsort(-cnt, kind="stable")[:FREQUENT]]
    top = top[np.isin(top, vals[cnt >= len(sample) / 200])]
    if len(top) < 2:
        return {}
    where = {int(v): i for i, v in enumerate(top)}
    x = np.zeros((len(sets), len(top)), np.float32)
    for r, s in enumerate(sets):
        x[r, [where[int(v)] for v in s[np.isin(s, top)]]] = 1
    c = np.nan_to_num(np.corrcoef(x.T))
    group: dict[int, int] = {}
    for i, v in enumerate(top):
        j = int(np.argmax(c[i, :i])) if i else 0
        group[int(v)] = group[int(top[j])] if i and c[i, j] > 0.6 else i
    return group


def _batches(it):
    """(ids, offsets, tokens) of Arrow batches (doc long, tokens packed)."""
    for ids, off, tok, _ in _sided(it):
        yield ids, off, tok


def _sided(it):
    """_batches, and the side of each text; both sides where there is no such column."""
    for b in it:
        side = b.column("side").to_numpy() if "side" in b.schema.names else np.full(b.num_rows, 3)
        yield b.column("doc").to_numpy(), *unpacked(b.column("tokens")), side.astype(np.int8)


def histogram(docs: DataFrame) -> np.ndarray:
    """How many docs have a word of each of HISTOGRAM buckets; summed in each task first."""
    import pyarrow as pa

    def run(it):
        c = np.zeros(HISTOGRAM, np.int64)
        for _, off, tok in _batches(it):
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            c += np.bincount((tok[occurrence(tok, row) == 0] % np.uint64(HISTOGRAM)).astype(np.int64), minlength=HISTOGRAM)
        b = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(c[b])], names=["b", "n"])

    got = docs.select("doc", "tokens").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(HISTOGRAM, np.int64)
    counts[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return counts


def near_links(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """docs(doc long unique, tokens: hashed words with repeats, sorted and packed) -> (a, b) with a < b and similarity >= near.

    Complete but for collisions of 64-bit hashes. docs should be a written table: it is read several times.
    """
    pairs = near_candidates(docs, histogram(docs), near)
    pairs = pairs.join(docs.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a").join(docs.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b")
    return verified(pairs.select("a", "b", "ta", "tb"), near)


def near_candidates(docs: DataFrame, counts: np.ndarray, near: float = NEAR) -> DataFrame:
    """A written table (a, b), a < b, with all pairs of near_links and some more; counts is the histogram of docs.

    With a column side (1, 2, or 3 for texts on both) only pairs that have a text on each side.
    """
    import pyarrow as pa
    import zstandard

    spark, sided, n_docs = docs.sparkSession, "side" in docs.columns, docs.count()
    picked = docs.select("tokens", F.xxhash64("doc").alias("h")).orderBy("h").limit(SAMPLE).toArrow().column("tokens")
    picked = [np.split(tok, off[1:-1]) for off, tok in map(unpacked, picked.chunks)]
    scheme = Scheme(near, counts, n_docs, _correlated([x for some in picked for x in some]))
    sent = spark.sparkContext.broadcast(scheme)
    log2 = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, BITS_A_WORD * int(counts.sum()))))))
    bits = 1 << log2

    def spots(keys):
        return (_mix(keys, 17) >> np.uint64(64 - log2)).astype(np.int64)

    def short(keys):
        return (keys >> np.uint64(64 - KEY_BITS)).view(np.int64)

    def hot(it):
        for ids, off, tok in _batches(it):
            some = [short(k) for role, k, _, _ in sent.value.signatures(ids, off, tok) if role == 0]
            if some:
                key, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    heavy = docs.where(F.pmod(F.xxhash64("doc"), F.lit(COUNTED)) == 0).mapInArrow(hot, "key long, n long").groupBy("key").agg((F.sum("n") * F.lit(COUNTED)).alias("n"))
    heavy = heavy.where(F.col("n") > HOT).orderBy(F.desc("n")).limit(SPLIT).toArrow().sort_by("key")
    # (keys, tasks of each): how a hot key is split changes no result, only where its rows meet
    split = spark.sparkContext.broadcast((heavy.column("key").to_numpy(), -(-heavy.column("n").to_numpy() // HOT)))

    def salted(keys, role, ids):
        """(keys, places): index rows of a hot key go to one of its parts, probes to each of them."""
        hot_keys, parts = split.value
        at = np.arange(len(keys))
        if not len(hot_keys):
            return keys, at
        spot = np.searchsorted(hot_keys, keys).clip(0, len(hot_keys) - 1)
        n = np.where(hot_keys[spot] == keys, parts[spot], 1)
        if role == 0:
            salt = _mix(ids.astype(np.uint64), 29) % n.astype(np.uint64)
        else:
            at = np.repeat(at, n)
            salt = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        return np.where(n[at] > 1, (_mix(keys[at].astype(np.uint64) + salt, 31) >> np.uint64(64 - KEY_BITS)).view(np.int64), keys[at]), at

    def put(bitmap, at):
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(bitmap, at):
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def mark(it):
        # of each role: keys that a text has, keys that more than one has (or one of them twice); with sides, keys of each
        seen = np.zeros((2, 2, bits // 8), np.uint8)
        for ids, off, tok, side in _sided(it):
            keys: tuple[list, list] = ([], [])
            for role, k, i, _ in sent.value.signatures(ids, off, tok):
                if sided:
                    at = spots(k)
                    for plane in (0, 1):
                        put(seen[role, plane], at[side[i] >> plane & 1 == 1])
                else:
                    keys[role].append(spots(k))
            for role in (0, 1):
                if keys[role]:
                    at, c = np.unique(np.concatenate(keys[role]), return_counts=True)
                    put(seen[role, 1], at[(c > 1) | has(seen[role, 0], at)])
                    put(seen[role, 0], at)
        z = zstandard.ZstdCompressor(level=1)
        parts = seen.reshape(2, 2, -1, CHUNK)
        for role in (0, 1):
            for c in range(parts.shape[2]):
                if parts[role, :, c].any():
                    yield pa.RecordBatch.from_pydict({"chunk": [role * parts.shape[2] + c], "once": [z.compress(parts[role, 0, c].tobytes())], "more": [z.compress(parts[role, 1, c].tobytes())]}, schema=pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        once, more = np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)
        for o, t in zip(pdf.once, pdf.more):
            o, t = (np.frombuffer(d.decompress(x), np.uint8) for x in (o, t))
            more |= t if sided else t | (once & o)
            once |= o
        return pd.DataFrame({"chunk": pdf.chunk[:1], "once": [z.compress(once.tobytes())], "more": [z.compress(more.tobytes())]})

    # 4 bitmaps of bounded size, compressed
    marks = docs.mapInArrow(mark, "chunk int, once binary, more binary").groupBy("chunk").applyInPandas(merge, "chunk int, once binary, more binary").collect()
    shared = spark.sparkContext.broadcast({r.chunk: (bytes(r.once), bytes(r.more)) for r in marks})

    def emit(it):
        d = zstandard.ZstdDecompressor()
        seen = np.zeros((2, 2, bits // 8 // CHUNK, CHUNK), np.uint8)
        for c, both in shared.value.items():
            for i, x in enumerate(both):
                seen[c // seen.shape[2], i, c % seen.shape[2]] = np.frombuffer(d.decompress(x), np.uint8)
        seen = seen.reshape(2, 2, -1)
        for ids, off, tok, side in _sided(it):
            scheme = sent.value
            for role, k, i, own in scheme.signatures(ids, off, tok):
                # a key matters if another text, of the other side, has it in the other role
                at = spots(k)
                if sided:
                    keep = (side[i] & 1 > 0) & has(seen[1 - role, 1], at) | (side[i] & 2 > 0) & has(seen[1 - role, 0], at)
                else:
                    keep = np.where(own, has(seen[1 - role, 1], at), has(seen[1 - role, 0], at))
                if keep.any():
                    key, at = salted(short(k[keep]), role, ids[i[keep]])
                    i = i[keep][at]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side[i] + np.int8(4 * role)), pa.array(ids[i].astype(np.int64)), pa.array(scheme.sizes[i].astype(np.int32)), pa.array(scheme.sketch[i].view(np.int64))], names=["key", "role", "doc", "n", "sketch"])

    def fits(nx, x, sx, rx, nq, q, sq, rq):
        """Whether x can be the shorter of a near-same pair with q, and they are on different sides."""
        ok = ((nx < nq) | (nx == nq) & (x < q)) & (nx >= nq * lower - 1e-9)
        ok &= np.bitwise_count((sx ^ sq).view(np.uint64)) <= (1 - near) * (nx + nq) + 1e-9
        return ok & ((rx | rq) & 3 == 3) if sided else ok

    def meet(it):
        """Pairs of probes and index signatures of one key whose sizes and sketches allow it; rows come sorted by key, probes first."""
        key, probes = None, None
        for b in it:
            cols = [c.to_numpy() for c in b.columns]
            cuts = np.r_[0, np.flatnonzero(np.diff(cols[0])) + 1, len(cols[0])]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            if not len(cols[0]):
                continue
            asked = np.add.reduceat((cols[1] >= 4).astype(np.int64), cuts[:-1])
            had = np.diff(cuts) - asked
            # only keys with both roles matter, and those that may go on in the next batch or come from the last one
            few = (asked > 0) & (had > 0) & (asked * had <= FEW)
            alone = (asked > 0) & (had > 0) & ~few
            few[[0, -1]], alone[[0, -1]] = False, True
            # keys with few pairs all at once
            at = np.flatnonzero(few)
            for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(asked[at] * had[at]) // 1_000_000)) + 1):
                m, lo = asked[some] * had[some], cuts[:-1][some]
                place, width, lo = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m), np.repeat(asked[some], m), np.repeat(lo, m)
                q, x = lo + place % width, lo + width + place // width
                _, role, doc, n, sketch = cols
                ok = fits(n[x], doc[x], sketch[x], role[x], n[q], doc[q], sketch[q], role[q])
                out.append((doc[x[ok]], doc[q[ok]]))
            for lo, hi in zip(cuts[:-1][alone], cuts[1:][alone]):
                k, role, doc, n, sketch = (c[lo:hi] for c in cols)
                if k[0] != key:
                    key, probes = k[0], None
                cut = int((role < 4).sum())
                new = len(role) - cut
                if new:
                    first = (doc[:new], n[:new], sketch[:new], role[:new])
                    probes = first if probes is None else tuple(np.concatenate(x) for x in zip(probes, first))
                if not cut or probes is None:
                    continue
                x, nx, sx, rx = doc[new:], n[new:], sketch[new:], role[new:]
                q, nq, sq, rq = (v[None, :] for v in probes)
                step = max(1, 1_000_000 // q.size)
                for at in range(0, len(x), step):
                    xs, ns, ss, rs = (v[at : at + step, None] for v in (x, nx, sx, rx))
                    i, j = np.nonzero(fits(ns, xs, ss, rs, nq, q, sq, rq))
                    if len(i):
                        out.append((x[at : at + step][i], probes[0][j]))
            if out:
                x, q = (np.concatenate(v) for v in zip(*out))
                u = np.unique(np.stack([np.minimum(x, q), np.maximum(x, q)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])

    lower = near / (2 - near)
    sig = docs.mapInArrow(emit, "key long, role byte, doc long, n int, sketch long")
    sig = sig.repartition("key").sortWithinPartitions("key", F.desc("role"))
    return written(sig.mapInArrow(meet, "a long, b long").distinct(), "candidates")


def alike(x, y, near: float) -> np.ndarray:
    """Which of the pairs of texts, two Arrow arrays of packed words, are near-same."""
    words = [unpacked(x), unpacked(y)]
    rows = [np.repeat(np.arange(len(x)), np.diff(off)) for off, _ in words]
    sets = [apart(tok, occurrence(tok, row)) for (_, tok), row in zip(words, rows)]
    # words that both sides of a pair have stand side by side once all are sorted by pair and word
    row, word = np.concatenate(rows), np.concatenate(sets)
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (word[1:] == word[:-1])], minlength=len(x))
    return 2 * both >= near * sum(np.diff(off) for off, _ in words) - 1e-9


def verified(pairs: DataFrame, near: float) -> DataFrame:
    """Those of pairs(a, b, ta, tb), with packed words, whose words are near-same; without ta and tb."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            yield batch.select(batch.schema.names[:-2]).filter(pa.array(alike(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), near)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields[:-2])
    return pairs.mapInArrow(run, kinds)


def documents_of(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """records(keys..., ingested_at, hash, tokens, ...) -> (newest row of each key with doc, distinct documents (doc, tokens)).

    Records with the same bag of words share a doc; those without words are left out.
    """
    records = written(records, "records")
    docs = records.where("hash is not null").select("hash", "tokens").distinct()
    # numbers given once and written are stable; they are small, which keeps what is shuffled small
    docs = written(docs.select(F.monotonically_increasing_id().alias("doc"), "hash", "tokens"), "documents")
    members = written(newest(records.drop("tokens"), keys).join(docs.select("doc", "hash"), "hash").drop("hash"), "members")
    drop(records)
    return members, docs.drop("hash")


def near_pairs(records: DataFrame, near: float = NEAR) -> DataFrame:
    """records(field_name, key, text, ingested_at) -> (field_name, key_a, key_b), key_a < key_b, of near-same texts of one field."""
    members, docs = documents_of(with_words(records, "text"), ["field_name", "key"])
    links = near_links(docs, near)
    members = members.select("field_name", "key", "doc")
    a = members.withColumnsRenamed({"key": "ka", "doc": "a"})
    b = members.withColumnsRenamed({"key": "kb", "doc": "b"})
    same = a.join(b.withColumnRenamed("b", "a"), ["field_name", "a"]).where("ka < kb").select("field_name", "ka", "kb")
    # links are between different docs and each is there once, so no pair comes twice
    linked = links.join(a, "a").join(b, ["b", "field_name"]).where("ka <> kb").select("field_name", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    return same.unionByName(linked).withColumnsRenamed({"ka": "key_a", "kb": "key_b"})


def components(edges: DataFrame, scope: str) -> DataFrame:
    """edges(scope, u, v) -> (scope, u, root) of every node with an edge: root is the least node connected to it.

    Large and small stars in turn, each round written; their number grows with the logarithm of the longest chain.
    """
    ends = lambda x, y: [F.col(scope), F.col(x).alias("u"), F.col(y).alias("v")]
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64(scope, "u", "v").cast("decimal(38,0)"))).first()
    now = written(edges.select(scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = state(now)
    while True:
        both = now.unionByName(now.select(*ends("v", "u")))
        least = both.groupBy(scope, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = written(both.where("v > u").join(least, [scope, "u"]).select(*ends("v", "m")).distinct(), "edges")
        least = large.groupBy(scope, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [scope, "u"]).where("v <> m").select(*ends("v", "m"))
        before, now = now, written(small.unionByName(least.select(*ends("u", "m"))).distinct(), "edges")
        drop(before, large)
        last, seen = seen, state(now)
        if last == seen:
            return now.withColumnRenamed("v", "root").unionByName(now.select(scope, F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def near_groups(records: DataFrame, near: float = NEAR) -> DataFrame:
    """records(field_name, key, text, ingested_at) -> (field_name, key, group_id, n_links) of every key.

    Texts of one field that are near, or joined by a chain of such texts, have one group_id, the least key among them.
    n_links counts the other bags of words of the field that are near; texts under LEAST_WORDS words stand alone.
    """
    members, docs = documents_of(with_words(records, "text"), ["field_name", "key"])
    first = members.groupBy("field_name", "doc").agg(F.min("key").alias("rep"))
    links = near_links(docs, near)
    edges = links.join(first.select("field_name", F.col("doc").alias("a"), F.col("rep").alias("u")), "a").join(first.select("field_name", F.col("doc").alias("b"), F.col("rep").alias("v")), ["field_name", "b"])
    edges = written(edges.select("field_name", "u", "v"), "links")
    degree = edges.select("field_name", F.col("u").alias("rep")).unionByName(edges.select("field_name", F.col("v").alias("rep"))).groupBy("field_name", "rep").agg(F.count("*").alias("n_links"))
    root = components(edges, "field_name").withColumnRenamed("u", "rep")
    of = first.join(degree, ["field_name", "rep"], "left").join(root, ["field_name", "rep"], "left")
    rows = members.join(of, ["field_name", "doc"]).select("field_name", "key", F.coalesce("root", "rep").alias("group_id"), "n_links")
    every = records.select("field_name", "key").dropna().distinct()
    return every.join(rows, ["field_name", "key"], "left").select("field_name", "key", F.coalesce("group_id", "key").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
