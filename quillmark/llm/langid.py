"""Problem 5: languages of texts and of their parts, by multilingual mixture inference.

Hashed word and character n-gram counts per language, taken over all labelled texts, give every line a likelihood in
every language. Expectation-maximisation estimates each text's proportions of languages; the set of languages is chosen
by penalised likelihood; each line then gets the language of its largest responsibility.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spread
from .lookalike import form_of

LANGS = ("en", "hi", "hi-Latn", "mr", "bn", "ta", "ur", "zh")
#: Buckets of hashed n-grams; counts under which a word is judged by its letters only; cost of each further language in nats.
BUCKETS, KNOWN, PENALTY = 1 << 17, 8, 6.0
#: Gain of log-likelihood in a step under which expectation-maximisation ends.
TOLERANCE = 1e-3
#: Share of the words that a language needs in lines of its own to count in a text of several languages.
QUARTER = 0.25
#: Evidence (nats) that a word may give for or against a language at most, so that single loan words don't decide.
CLIP = 4.0

# Other spellings and names of the codes.
ALIASES = {
    "en": "en eng english en-in en-us en-gb en_in", "hi": "hi hin hindi hi-deva hi-in hi_in hi_deva", "hi-Latn": "hi-latn hi_latn hinglish hin-latn hi-rom romanised hindi hilatn",
    "mr": "mr mar marathi mr-in mr-deva", "bn": "bn ben bengali bangla bn-in bn-beng", "ta": "ta tam tamil ta-in ta-taml", "ur": "ur urd urdu ur-pk ur-in", "zh": "zh zho chi chinese zh-cn zh-hans", "mul": "mul mixed multiple multilingual multi",
}
UNKNOWN = "und unknown none null n/a na ? unk undetermined zxx"


def code_of(label):
    """The code that a label names; '' where it is missing or says unknown; otherwise the label as it is, a wrong one."""
    c = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(c.isin("", *UNKNOWN.split()), F.lit(""))
    for code, names in ALIASES.items():
        out = out.when(c.isin(*{n for n in names.split(" ")} | {code.lower(), "romanised hindi"} if code == "hi-Latn" else set(names.split(" "))), F.lit(code))
    return out.otherwise(c)


_P: list = []


def _words(line: str) -> list[str]:
    import regex

    if not _P:
        _P.append(regex.compile(r"(?<!\S)[@#]\S+|https?://\S+|[\p{L}\p{M}]+(?:['’]\p{L}+)?", regex.V1))
    out = []
    for w in _P[0].findall(line.lower()):
        if w[0] not in "@#" and "://" not in w:
            if "一" <= w[0] <= "鿿":
                out += list(w)
            else:
                out.append(w)
    return out


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s) & (BUCKETS - 1)


def _grams(w: str) -> list[int]:
    p = f"^{w}$"
    return [_hash("3" + p[i : i + 3]) for i in range(len(p) - 2)] if len(w) > 1 else [_hash("3" + p)]


class Model:
    """Log-likelihood of words per language from counts[language, bucket]."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        total = counts.sum(axis=1, keepdims=True) + 1.0
        self.log = np.ascontiguousarray(np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32).T)
        self.seen = counts.sum(axis=0)
        self.cache: dict[str, np.ndarray] = {}

    def learn(self, words) -> None:
        """Clipped log-likelihoods of words, their best being 0, computed together."""
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        if len(self.cache) > 300_000:
            self.cache.clear()
            new = list(words)
        grams = [_grams(w) for w in new]
        n = np.array([len(g) for g in grams])
        v = np.add.reduceat(self.log[list(itertools.chain.from_iterable(grams))], np.cumsum(n) - n, axis=0) / n[:, None] * 1.5
        h = np.array([_hash("w" + w) for w in new])
        known = self.seen[h] >= KNOWN
        v[known] = 0.3 * v[known] + self.log[h[known]]
        v = np.maximum(v - v.max(axis=1, keepdims=True), -CLIP)
        self.cache.update(zip(new, v))

    def lines(self, texts: list[str | None]) -> list[list[tuple[int, np.ndarray, int]]]:
        """For each text (line number, likelihoods, words) of its lines with words."""
        cut = [[(i, ws) for i, x in enumerate((t or "").split("\n")) if (ws := _words(x))] for t in texts]
        flat = [ws for rows in cut for _, ws in rows]
        if not flat:
            return [[] for _ in texts]
        every = list(itertools.chain.from_iterable(flat))
        number = {w: k for k, w in enumerate(dict.fromkeys(every))}
        self.learn(number)
        table = np.array([self.cache[w] for w in number])
        n = np.array([len(ws) for ws in flat])
        sums = np.add.reduceat(table[[number[w] for w in every]], np.cumsum(n) - n, axis=0).astype(float)
        at = iter(zip(sums, n.tolist()))
        return [[(i, *next(at)) for i, _ in rows] for rows in cut]

    def infer(self, rows: list[tuple[int, np.ndarray, int]]):
        """(proportions by language, [(line number, language index or -1, confidence, words, has its own)]); None without words."""
        if not rows:
            return None
        like = np.array([r[1] for r in rows])
        n = np.array([r[2] for r in rows], float)
        first = int(like.sum(axis=0).argmax())
        # a mixture gains over one language at most what each line gains by its better one; others can't pay the penalty
        gain = np.maximum(0.0, like - like[:, [first]]).sum(axis=0)
        fits = [first, *[j for j in np.argsort(-gain, kind="stable").tolist() if gain[j] > PENALTY and j != first]]
        best = None
        for size in range(1, len(fits) + 1):
            sets = list(itertools.combinations(fits, size))
            # no mixture is likelier than each line's best language in the set: sets that can't win are not estimated
            most = [float(like[:, some].max(axis=1).sum()) - PENALTY * size for some in sets]
            for at in sorted(range(len(sets)), key=lambda at: -most[at]):
                if best is not None and most[at] + 1e-6 <= best[0]:
                    break
                pi, r, ll = self._em(like[:, sets[at]], n)
                if best is None or ll - PENALTY * size > best[0]:
                    best = (ll - PENALTY * size, sets[at], pi, r)
        _, some, pi, r = best
        top = np.sort(like, axis=1)
        out = []
        for k, (i, _, words) in enumerate(rows):
            j = int(r[k].argmax())
            # a line of names or handles fits several languages alike: it has no language of its own
            plain = top[k, -1] - top[k, -2] < 1.0 + 0.35 * words
            out.append((i, some[j] if not plain or len(some) == 1 else -1, float(r[k, j]), int(words), not plain))
        return {some[j]: float(pi[j]) for j in range(len(some))}, out

    def _em(self, like: np.ndarray, n: np.ndarray):
        k = like.shape[1]
        pi = np.full(k, 1.0 / k)
        if k == 1:
            return pi, np.ones_like(like), float(like.sum())
        last = -np.inf
        while True:
            a = like + np.log(pi + 1e-9)
            m = a.max(axis=1, keepdims=True)
            e = np.exp(a - m)
            r = e / e.sum(axis=1, keepdims=True)
            ll = float((m[:, 0] + np.log(e.sum(axis=1))).sum())
            if ll - last < TOLERANCE:
                return pi, r, ll
            last, pi = ll, (r * n[:, None]).sum(axis=0) / n.sum()


def counts_of(labelled: DataFrame) -> np.ndarray:
    """labelled(lang, text): n-gram counts per language over all rows, summed in each task first; at most languages x BUCKETS rows reach the driver."""
    import pyarrow as pa

    def run(it):
        c = np.zeros((len(LANGS), BUCKETS), np.int64)
        for b in it:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in LANGS:
                    seen.setdefault(lang, Counter()).update(_words(text or ""))
            for lang, words in seen.items():
                at, times = [], []
                for w, n in words.items():
                    h = [_hash("w" + w), *_grams(w)]
                    at += h
                    times += [n] * len(h)
                np.add.at(c[LANGS.index(lang)], at, times)
        lang, spot = np.nonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(spot.astype(np.int32)), pa.array(c[lang, spot].astype(np.int64))], names=["lang", "spot", "n"])

    got = spread(labelled.select("lang", "text")).mapInArrow(run, "lang int, spot int, n long").groupBy("lang", "spot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(LANGS), BUCKETS))
    out[got.column("lang").to_numpy(), got.column("spot").to_numpy()] = got.column("n").to_numpy()
    return out


def labelled_texts(documents: DataFrame, memes: DataFrame) -> DataFrame:
    """(lang, text) of all texts with a label of one language; wrong labels among them are outweighed."""
    docs = documents.select(code_of(F.col("lang")).alias("lang"), "text")
    return docs.unionByName(memes.select(code_of(F.col("ocr_lang")).alias("lang"), F.col("ocr").alias("text"))).where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())


def languages(df: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """df with (lang_code, confidence, segments array<struct<line int, lang string, confidence double, words int>>) in place of the text.

    lang_code is `mul` where two languages each hold at least QUARTER of the words in lines of their own; null (with
    confidence 0.0 and no segments) for null and blank texts and those without letters.
    """
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    made = ["lang_code", "confidence", "segments"]
    rest = [c for c in df.columns if c not in (text, *made)]
    item = pa.struct([("line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])

    def one(model: Model, lines):
        got = model.infer(lines)
        if not got:
            return None, 0.0, []
        pi, lines = got
        votes: dict[int, int] = {}
        for _, j, _, w, own in lines:
            if own and j >= 0:
                votes[j] = votes.get(j, 0) + w
        if not votes:
            for _, j, _, w, _ in lines:
                if j >= 0:
                    votes[j] = votes.get(j, 0) + w
            if not votes:
                votes = {max(pi, key=pi.get): 1}
        n = sum(votes.values())
        ranked = sorted(votes, key=lambda j: (-votes[j], j))
        several = len(ranked) > 1 and votes[ranked[1]] >= QUARTER * n
        main = LANGS[ranked[0]]
        conf = [c for _, j, c, _, _ in lines if j == ranked[0]]
        seg = [{"line": i, "lang": LANGS[j], "confidence": c, "words": w} for i, j, c, w, _ in lines if j >= 0]
        return ("mul" if several else main), float(np.mean(conf)) if conf else 0.0, seg

    def run(it):
        model = Model(sent.value.astype(np.float64))
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows = [one(model, x) for x in model.lines([form_of(t) for t in part.column(len(rest)).to_pylist()])]
                found = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(item))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *found], names=[*rest, *made])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.select(*rest, text).mapInArrow(run, f"{kinds}lang_code string, confidence double, segments array<struct<line int, lang string, confidence double, words int>>")


def enough_pieces(text: str):
    """Whether a text has at least five blank-separated pieces."""
    return F.coalesce(F.col(text).rlike(r"\S+(?:\s+\S+){4}"), F.lit(False))


def is_wrong(label: str):
    """Whether a label is missing, unknown or another code than the lang_code found."""
    return F.col("lang_code").isNotNull() & (code_of(F.col(label)) != F.col("lang_code"))
