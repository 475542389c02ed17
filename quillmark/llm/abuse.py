"""Problem 2: abusive, hateful or sexually explicit language, scored by FTRL-proximal logistic regression.

Lines of a text are brought to one form, disguised spellings are undone where they give a known coarse word, and hashed
word n-grams and skip-grams are weighed. The labels that the corpus has are opinions about whole texts, so the model is
trained in rounds: first on bounded samples of lines of texts labelled offensive or not, then on the lines that the last
round finds abusive or harmless, those between left out. A few general frames with coarse words help where labels are
rare. The sparse weights are broadcast.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import share
from .linear import Ftrl, Rows, bucket, score
from .lookalike import form_of

#: Bound of each of both samples of labelled lines; lines that a feature must be in; fillings of each frame; score from which a text counts as abusive.
SAMPLE_LINES, LEAST, FILLS, THRESHOLD, SEED = 40_000, 4, 6, 0.6, 42
#: Scores from which a line counts as abusive in the first and in later rounds, and under which it counts as harmless; rounds after the first.
FIRST, LATER, CLEAN, ROUNDS = 0.75, 0.8, 0.6, 4
# Labels of texts that somebody finds offensive, and that nobody does.
OFFENSIVE, INOFFENSIVE = ["very_offensive", "hateful_offensive"], ["not_offensive"]

# Coarse words of abuse, by language; {S} in the frames below.
COARSE = {
    "en": ["bastard", "asshole", "bitch", "slut", "whore", "prick", "cunt", "wanker", "motherfucker", "shithead", "dickhead", "scumbag", "dumbass", "moron", "piece of shit", "idiotic bastard", "fucker", "son of a bitch", "douchebag", "jackass", "retard", "dipshit", "twat", "arsehole", "fuckface", "cocksucker", "skank", "tosser"],
    "hl": ["chutiya", "madarchod", "behenchod", "bhenchod", "gandu", "randi", "kamine", "kamina", "harami", "haramkhor", "bhosdike", "kutte ki aulaad", "suar ki aulaad", "kutta saala", "saala kutta", "gadhe ki aulaad", "lavde", "chutiye", "kutiya", "haramzada", "haramzaade", "suar"],
    "hi": ["चूतिया", "मादरचोद", "बहनचोद", "भेनचोद", "गांडू", "रंडी", "कमीने", "कमीना", "हरामी", "हरामखोर", "भोसड़ीके", "कुत्ते की औलाद", "सूअर की औलाद", "हरामज़ादे", "हरामजादा", "कुतिया", "गधे की औलाद"],
    "mr": ["हरामखोर", "हलकट रांडे", "भडव्या", "रांडेच्या", "कुत्र्या", "गाढवा", "नालायक", "चुतिया", "हरामी", "हलकट", "भिकारचोट", "आयघाल्या", "डुकरा", "झवाड्या"],
    "bn": ["শুয়োরের বাচ্চা", "খানকি", "হারামজাদা", "কুত্তার বাচ্চা", "মাদারচোদ", "চুদির ভাই", "বেশ্যা", "হারামি", "বোকাচোদা", "কুত্তা", "খানকির ছেলে", "মাগি"],
    "ta": ["நாய் மகனே", "தேவடியா", "பன்றி", "தேவிடியா மகனே", "நாயே", "பொறுக்கி", "முட்டாள் நாயே", "ஓத்தா", "புண்டை", "கேடுகெட்டவனே", "எருமை மாடே", "தாயோளி"],
}
# General frames of abuse, degradation, threats and explicit offers. N a name, G a group of people, S a coarse word.
ABUSIVE = {
    "en": ["you are a S", "N you are nothing but a S", "hey S go away", "such a stupid S this N", "N and all his friends are S", "I want to kill every G", "all G must die", "G are subhuman filth", "we will beat G until they leave", "G girls are whores", "have sex with N tonight", "N naked pictures here", "porn video of N", "show me your boobs N", "fuck you N"],
    "hl": ["tu S hai", "N to bada S nikla", "oye S bhaag", "har S N jaisa hota hai", "G ko maar daalo", "saare G gande hain bhagao", "N ki nangi video dekho", "N ke saath sex karna hai", "G logon ko jeene mat do"],
    "hi": ["तुम एकदम S हो", "N तो बड़ा S निकला", "ओए S भाग", "G को मार डालो", "सारे G गंदे हैं भगाओ", "N की नंगी वीडियो देखो", "N के साथ सेक्स करना है"],
    "mr": ["तू S आहेस", "N तर मोठा S निघाला", "ए S पळ", "G ना मारून टाका", "सगळे G घाण आहेत", "N चा नागडा व्हिडिओ बघा"],
    "bn": ["তুই একটা S", "N তো বড় S", "এই S ভাগ", "G দের মেরে ফেলো", "সব G নোংরা", "N এর নগ্ন ভিডিও দেখো"],
    "ta": ["நீங்கள் எல்லாம் S", "N பெரிய S", "ஏய் S போ", "G எல்லோரையும் கொல்லு", "எல்லா G அசுத்தம்", "N நிர்வாண வீடியோ பார்"],
}
# General frames with coarse words in a harmless sense, or about them.
HARMLESS = {
    "en": ["the word S is rude", "do not say S to N", "N was punished for writing S", "calling G S is wrong", "the film has sex scenes", "the game killed my phone battery", "kill the weeds", "G are our friends", "she wore a nude shade"],
    "hl": ["S bolna galat hai", "N ne S likha to saza mili", "G hamare dost hain", "machhar ko maaro"],
    "hi": ["S बोलना गलत है", "N ने S लिखा तो सज़ा मिली", "G हमारे दोस्त हैं", "मच्छर को मारो"],
    "mr": ["S बोलणे चुकीचे आहे", "G आमचे मित्र आहेत", "डास मारा"],
    "bn": ["S বলা ভুল", "G আমাদের বন্ধু", "মশা মারো"],
    "ta": ["S சொல்வது தவறு", "G நம் நண்பர்கள்", "கொசுவை கொல்"],
}
# Signs that stand for letters in disguised words.
LEET = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "!": "i", "5": "s", "7": "t", "4": "a"}
# Syllables of the names that fill frames.
_SYLLABLES = {"en": ["ba", "ko", "ri", "tu", "mel", "dor", "shi", "van", "pra", "lis"], "hi": ["बा", "को", "री", "तु", "मे", "दो", "शि"], "bn": ["বা", "কো", "রি", "তু", "মে", "দো"], "ta": ["பா", "கோ", "ரி", "து", "மே", "லா"]}
#: Words that a disguised one may stand for.
_LEXICON = frozenset(w for ps in COARSE.values() for p in ps for w in p.split() if len(w) > 3) | {"fuck", "shit", "dick", "cock", "pussy", "porn", "nudes", "boobs", "sex", "horny", "chudai"}


def _patterns():
    import regex

    v = regex.V1
    return (
        regex.compile(r"[\p{L}\p{M}\p{N}@$*#!]+(?:['’][\p{L}]+)?", v),
        regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:[\p{L}\p{N}@$]\p{M}*([ .\-_*]))(?:[\p{L}\p{N}@$]\p{M}*\1)+[\p{L}\p{N}@$]\p{M}*(?![\p{L}\p{M}\p{N}])", v),
        regex.compile(r"(.)\1{2,}", v),
        regex.compile(r"(?<=\s|^)@[\w.]+", v),
    )


_P: list = []


def words_of(line: str) -> list[str]:
    """Lower-cased words of a line, disguised coarse words in their plain spelling; handles are left out."""
    if not _P:
        _P.extend(_patterns())
    word, spaced, repeated, handle = _P
    line = handle.sub(" ", line.lower())
    line = spaced.sub(lambda m: m.group().replace(m.group(1), ""), line)
    out = []
    for w in word.findall(line):
        if any(c in LEET or c in "*#" for c in w) or repeated.search(w):
            w = _undisguised(w, repeated)
        w = w.strip("*#!@$")
        if w:
            out.append(w)
    return out


def _undisguised(w: str, repeated) -> str:
    import re

    for keep in (w, w.strip("!")):
        plain = "".join(LEET.get(c, c) for c in keep)
        for x in (plain, repeated.sub(r"\1", plain), repeated.sub(r"\1\1", plain)):
            if x in _LEXICON:
                return x
        if ("*" in plain or "#" in plain) and any(c.isalpha() for c in plain):
            hide = re.compile(re.sub(r"[*#]+", lambda m: f".{{{max(1, len(m.group()) - 1)},{len(m.group()) + 1}}}", re.sub(r"[^\w*#]", "", plain)))
            found = sorted(x for x in _LEXICON if hide.fullmatch(x))
            if found:
                return min(found, key=lambda x: (abs(len(x) - len(plain)), x))
    return w


def features(ws: list[str]) -> np.ndarray:
    """Hashed unigrams, bigrams, trigrams and skip-grams (one or two words left out)."""
    if not ws:
        return np.zeros(0, np.int64)
    b = ["<s>", *ws, "</s>"]
    f = {"1", *("u " + w for w in ws)}
    f |= {f"b {x} {y}" for x, y in itertools.pairwise(b)}
    f |= {f"t {x} {y} {z}" for x, y, z in zip(b, b[1:], b[2:])}
    f |= {f"k {x} {y}" for g in (2, 3) for x, y in zip(b, b[g:])}
    return np.unique(np.fromiter((bucket(x) for x in f), np.int64))


def frame_lines(rng: np.random.Generator) -> tuple[list[str], list[float]]:
    """The frames filled at random, and their labels."""

    def name(lang: str) -> str:
        return "".join(rng.choice(_SYLLABLES[{"hl": "en", "mr": "hi"}.get(lang, lang)], 3)).capitalize()

    def fill(frame: str, lang: str) -> str:
        return " ".join(str(rng.choice(COARSE[lang])) if w == "S" else name(lang) if w in "NG" else w for w in frame.split(" "))

    made = [(fill(f, lang), label) for label, frames in ((1.0, ABUSIVE), (0.0, HARMLESS)) for lang, fs in frames.items() for f in fs for _ in range(FILLS)]
    # names alone are harmless: the intercept must not make a text abusive
    made += [(" ".join(name(lang) for _ in range(int(rng.integers(1, 8)))), 0.0) for lang in COARSE for _ in range(10 * FILLS)]
    return [x for x, _ in made], [y for _, y in made]


def train(lines: list[np.ndarray], labels: np.ndarray) -> dict[int, float]:
    """Sparse weights from the features of lines with the labels of their texts (1 offensive, 0 not), and from the frames."""
    frames, known = frame_lines(np.random.default_rng(SEED))
    rows = Rows([*lines, *(features(words_of(x)) for x in frames)], LEAST)
    n, known = len(lines), np.array(known)
    labels = np.r_[labels, known]
    # both labels weigh as much, however many lines have them
    model = Ftrl(alpha=0.1, l1=1.0, l2=1.0).fit(rows, labels, np.r_[np.where(labels[:n] > 0, 1.0, labels[:n].sum() / max(1.0, (1 - labels[:n]).sum())), np.ones(len(known))])
    offensive = labels[:n] > 0
    for first in (FIRST, *[LATER] * (ROUNDS - 1)):
        # of a text labelled offensive only some lines are meant; lines that look abusive in texts labelled inoffensive are left out
        s = model.scores(rows)[:n]
        found = offensive & (s >= first)
        model = Ftrl(alpha=0.1, l1=1.0, l2=1.0).fit(rows, np.r_[found, known], np.r_[found | (s < CLEAN), np.ones(len(known))].astype(float))
    return model.compact()


def fit(memes: DataFrame) -> dict[int, float]:
    """Train on memes(row_id, ocr, offensive): at most SAMPLE_LINES lines of texts labelled offensive and as many of others, picked by a hash. Without labels the frames alone remain."""
    import pyarrow as pa

    def run(it):
        for b in it:
            rows = [features(ws) if len(ws := words_of(form_of(x))) > 1 else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["label", "at"])

    kind = F.lower(F.trim("offensive"))
    parts = memes.sparkSession.sparkContext.defaultParallelism
    lines, labels = [], []
    for label, kinds in ((1.0, OFFENSIVE), (0.0, INOFFENSIVE)):
        rows = memes.where(kind.isin(kinds) & F.col("ocr").isNotNull()).select("row_id", F.explode(F.split("ocr", "\n")).alias("line")).where("length(line) > 8")
        rows = rows.orderBy(F.xxhash64(F.lit(SEED), "row_id", "line"), "row_id", "line").limit(SAMPLE_LINES).select(F.lit(label).alias("label"), "line").distinct()
        got = rows.repartition(parts).mapInArrow(run, "label double, at array<long>").where("at is not null").orderBy(F.xxhash64("at"), "at").toArrow()
        lines += [x.values.to_numpy() for x in got.column("at").combine_chunks()] if got.num_rows else []
        labels += [label] * got.num_rows
    return train(lines, np.array(labels))


def scores(df: DataFrame, text: str, weights: dict[int, float]) -> DataFrame:
    """df with `score` in place of the text: the score of its worst line; null and blank texts score 0.0."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in df.columns if c not in (text, "score")]

    def run(it):
        w = sent.value
        for b in it:
            out = [max((score(w, features(ws)) for line in (form_of(t) or "").split("\n") if (ws := words_of(line))), default=0.0) for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(out, pa.float64())], names=[*rest, "score"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.select(*rest, text).mapInArrow(run, f"{kinds}score double")


def rates(scored: DataFrame, source: str) -> DataFrame:
    """(source_key, n_texts, n_abusive, rate) per source, however spelled; texts without a source are the source ''."""
    name = F.coalesce(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit(""))
    n, bad = F.count("*"), F.count_if(F.col("score") >= THRESHOLD)
    return scored.groupBy(name.alias("source_key")).agg(n.alias("n_texts"), bad.alias("n_abusive"), share(bad, n).alias("rate"))
