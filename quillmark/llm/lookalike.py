"""Problem 7: one consistent form for texts that look alike but differ in their characters.

The form is built relationally: pieces of text are exploded to positioned code points, decomposition and look-alike
mappings are joined by broadcast (their size is bounded by Unicode itself), combining marks are put in the order of
their class, clusters are recomposed, and the strings are rebuilt.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import newest, written

# Letters of other scripts and the Latin letter each looks like.
LOOKALIKES = """
а a с c е e о o р p х x у y і i ј j ѕ s һ h ԁ d ԛ q ԝ w ӏ l ѵ v
А A В B Е E К K М M Н H О O Р P С C Т T У Y Х X Ѕ S І I Ј J Ԛ Q Ԝ W Ү Y Ѵ V Ԍ G
Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X ο o ν v ι i α a κ k ρ p υ u ϲ c ϳ j
օ o ս u հ h ո n ɑ a ɡ g ı i
"""
# Kinds of compatibility decomposition whose result looks the same.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Stands for a class that no mark is above.
BLOCKED = 999
# Blocks whose inert code points count as safe in the quick check.
SAFE_BLOCKS = ((0x20, 0x7E), (0xA1, 0xFF), (0x900, 0x97F), (0x980, 0x9FF), (0xB80, 0xBFF), (0x600, 0x6FF), (0x2010, 0x2027), (0x3001, 0x3020), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xFF01, 0xFF1F), (0x1F300, 0x1FAFF))


def _invisible(ch: str) -> bool:
    """Zero-width and default-ignorable characters; emoji joiners and selectors are invisible too."""
    c = ord(ch)
    return unicodedata.category(ch) == "Cf" and not (0x600 <= c <= 0x605 or c in (0x6DD, 0x70F, 0x8E2)) or 0xFE00 <= c <= 0xFE0F or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0)


@functools.cache
def mapping() -> dict[int, str]:
    """Code point -> fully decomposed look-alike form, for every code point that changes; '' where it is invisible."""
    alike = dict(zip(*[iter(LOOKALIKES.split())] * 2))
    out: dict[int, str] = {}

    def full(ch: str) -> str:
        if _invisible(ch):
            return ""
        if unicodedata.category(ch) == "Zs":
            return " "
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0].startswith("<"):
            # a compatibility form that begins with a space is a spacing accent, which looks different from a space
            if parts[0] not in SAME_LOOK or parts[1] == "0020":
                return ch
            parts = parts[1:]
        if parts:
            return "".join(full(chr(int(p, 16))) for p in parts)
        return alike.get(ch, ch)

    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:
            continue
        if (to := full(chr(c))) != chr(c):
            out[c] = to
    for c in range(0xAC00, 0xD7A4):  # Hangul syllables decompose by rule
        out[c] = unicodedata.normalize("NFD", chr(c))
    for ch in "‐‑":
        out[ord(ch)] = "-"
    return out


@functools.cache
def compositions() -> dict[str, str]:
    """Decomposed cluster -> its composed character, as far as canonical composition makes one."""
    out = {}
    for c in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and (nfd := unicodedata.normalize("NFD", chr(c))) != chr(c) and unicodedata.normalize("NFC", nfd) == chr(c):
            out[nfd] = chr(c)
    return out


@functools.cache
def _steps() -> dict[str, str]:
    """Character and mark -> what they compose to; Hangul composes as whole clusters."""
    return {a + b: c for nfd, c in compositions().items() if not 0xAC00 <= ord(c) < 0xD7A4 and len(p := unicodedata.decomposition(c).split()) == 2 for a, b in [map(lambda x: chr(int(x, 16)), p)]}


@functools.cache
def joins_back() -> frozenset[str]:
    """Characters that are not the first of some composition, beside the combining marks."""
    return frozenset(ch for s in compositions() for ch in s[1:])


@functools.cache
def unsafe_pattern() -> str:
    """Matches in any text that the form may change (a superset): a character that is not safe in itself, two that
    compose, or two marks out of order."""
    changed, later = mapping(), joins_back()
    runs: list[list[int]] = []
    safe: set[str] = set()
    for lo, hi in ((9, 13), *SAFE_BLOCKS):
        for c in range(lo, hi + 1):
            if c not in changed and unicodedata.combining(chr(c)) in (0, 7, 9):
                safe.add(chr(c))
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    first: dict[str, str] = {}
    for s in compositions():
        if len(s) == 2 and s[0] in safe and s[1] in safe and s[1] in later:
            first[s[1]] = first.get(s[1], "") + s[0]
    by_class = {k: "".join(sorted(c for c in safe if unicodedata.combining(c) == k)) for k in (7, 9)}
    # the rare second characters are tested first, what stands before them only then
    seconds = "".join(sorted(first)) + by_class[7]
    pairs = [f"[{x}]{y}" for y, x in sorted(first.items())] + [f"[{by_class[9]}][{by_class[7]}]"]
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + f"]|[{seconds}](?<={'|'.join(pairs)})"


class _Forms(dict):
    """mapping() with every code point met so far: texts are translated without failed look-ups."""

    def __missing__(self, c: int) -> int:
        self[c] = c
        return c


@functools.cache
def _forms() -> _Forms:
    return _Forms(mapping())


def form_of(text: str | None) -> str | None:
    """The form that with_canonical gives, of one text: for operators that read their texts in Python anyway, so that no text is shuffled for it."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_forms()))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both mapping tables; their size is bounded by Unicode's code points (some 25,000 short rows)."""
    import pandas as pd

    rows = [(chr(c), i, ch, unicodedata.combining(ch)) for c, to in mapping().items() for i, ch in enumerate(to or ["\0"])]
    rows += [(chr(c), 0, chr(c), unicodedata.combining(chr(c))) for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c)) and c not in mapping()]
    chars = spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "sub", "to", "ccc"]), "ch string, sub int, to string, ccc int")
    pairs = spark.createDataFrame(pd.DataFrame(list(compositions().items()), columns=["cluster", "composed"]), "cluster string, composed string")
    return chars, pairs


def canonical_pieces(pieces: DataFrame) -> DataFrame:
    """pieces(piece string, distinct) -> (piece, canon): the relational normal form described above."""
    spark = pieces.sparkSession
    chars, pairs = _tables(spark)
    later = "".join(sorted(joins_back()))
    # a long piece is known by its hash: its code points do not carry it along
    pieces = pieces.select(F.when(F.octet_length("piece") <= 16, F.col("piece").cast("binary")).otherwise(F.unhex(F.md5("piece"))).alias("__id"), "piece")
    cps = pieces.select("__id", F.posexplode(F.split("piece", "(?s)(?<=.)(?=.)")).alias("pos", "ch"))
    cps = cps.join(F.broadcast(chars), "ch", "left").select("__id", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("to", "ch").alias("to"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
    cps = cps.where(F.col("to") != "\0")
    starts = (F.col("ccc") == 0) & ~F.lit(later).contains(F.col("to"))
    w = Window.partitionBy("__id").orderBy("pos", "sub")
    cps = cps.withColumn("block", F.sum(starts.cast("int")).over(w)).withColumn("run", F.sum((F.col("ccc") == 0).cast("int")).over(w))
    # marks are ordered by class between characters of class 0, equal classes keep their order
    ordered = F.array_sort(F.collect_list(F.struct("run", "ccc", "pos", "sub", "to")))
    clusters = cps.groupBy("__id", "block").agg(ordered.alias("marks")).withColumn("cluster", F.array_join(F.transform("marks", lambda x: x["to"]), ""))
    clusters = clusters.withColumn("__spread", (F.size("marks") > 2) & ~F.col("cluster").between("\u1100", "\u1113"))
    for size, left in ((None, "cluster"), (3, "cluster"), (2, "cluster")):
        head = F.col(left) if size is None else F.when(~F.col("__spread") & (F.length(left) > size), F.substring(left, 1, size))
        tail = F.lit("") if size is None else F.expr(f"substring({left}, {size + 1})")
        clusters = clusters.withColumn("__head", head).join(F.broadcast(pairs.withColumnRenamed("cluster", "__head")), "__head", "left")
        clusters = clusters.withColumn(left, F.when(F.col("composed").isNotNull(), F.concat("composed", tail)).otherwise(F.col(left)))
        if size is None:
            clusters = clusters.withColumn("__spread", F.col("__spread") & F.col("composed").isNull())
        clusters = clusters.drop("composed", "__head")
    clusters = clusters.withColumn("cluster", F.when(F.col("__spread"), _absorbed(F.col("marks"))).otherwise(F.col("cluster")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "cluster"))), lambda x: x["cluster"]), "")
    some = clusters.groupBy("__id").agg(whole.alias("canon"))
    return pieces.join(some, "__id", "left").select("piece", F.coalesce("canon", F.lit("")).alias("canon"))


def _absorbed(marks):
    """A cluster of three and more whose first character takes up the marks that compose with it, also past others of another class."""
    steps = F.create_map(*[F.lit(x) for pair in sorted(_steps().items()) for x in pair])

    def take(state, mark):
        # a mark is reached if none stands between, or only marks of lower classes
        free = (state["last"] < 0) | (state["last"] < mark["ccc"])
        made = F.when(free, F.try_element_at(steps, F.concat(state["base"], mark["to"])))
        return F.when(made.isNotNull(), F.struct(made.alias("base"), state["kept"].alias("kept"), state["last"].alias("last"))).otherwise(
            F.struct(state["base"].alias("base"), F.concat(state["kept"], mark["to"]).alias("kept"), F.when((mark["ccc"] == 0) | (state["last"] == BLOCKED), F.lit(BLOCKED)).otherwise(mark["ccc"]).alias("last"))
        )

    start = F.struct(F.get(marks, 0)["to"].alias("base"), F.lit("").alias("kept"), F.lit(-1).alias("last"))
    return F.aggregate(F.slice(marks, 2, F.size(marks)), start, take, lambda state: F.concat(state["base"], state["kept"]))


def with_canonical(df: DataFrame, text: str, out: str = "canon") -> DataFrame:
    """df with column `out`: `text` in its one consistent form. Null stays null, empty stays empty.

    Every text is looked at; the quick check only tells apart texts on which the form is the identity. Others are cut
    at plain blanks and line feeds, and only their distinct pieces pass through the mappings.
    """
    pattern = unsafe_pattern()
    df = df.drop(out)
    # plain ASCII is its own form
    unsafe = F.coalesce((F.octet_length(text) != F.length(text)) & F.col(text).rlike(pattern), F.lit(False))
    # written, so that the pattern is matched once for them
    rows = written(df.where(unsafe).withColumn("__key", F.md5(F.col(text))), "unsafe")
    texts = rows.select("__key", F.col(text).alias("__text")).distinct()
    parts = texts.select("__key", F.posexplode(F.split("__text", "(?<=[ \\n])")).alias("__i", "piece"))
    changed = canonical_pieces(parts.where(F.col("piece").rlike(pattern)).select("piece").distinct())
    parts = parts.join(changed, "piece", "left").select("__key", "__i", F.coalesce("canon", "piece").alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "piece"))), lambda x: x["piece"]), "")
    forms = parts.groupBy("__key").agg(whole.alias(out))
    # texts on which the form is the identity stay where they are: only the others are joined
    return df.where(~unsafe).withColumn(out, F.col(text)).unionByName(rows.join(forms, "__key").drop("__key"))


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """records(field_name, scope, key, text, ingested_at) -> (field_name, key_a, key_b): records of one field and scope
    whose texts have one form but differ in code points. Null and blank texts take no part; of a record delivered again
    the newest counts; texts of one raw form are no pair."""
    blank = F.regexp_replace("canon", r"\s+", "") == ""
    forms = with_canonical(records.dropna(subset=["key", "text"]), "text")
    forms = forms.select("field_name", "scope", "key", "ingested_at", F.unhex(F.md5("text")).alias("raw"), F.when(~blank, F.unhex(F.md5("canon"))).alias("form"))
    # hashes only are written; everything after reads this small table
    member = newest(written(forms, "forms"), ["field_name", "scope", "key"]).dropna(subset=["form"])
    changed = member.where("raw <> form").select("field_name", "scope", "form").distinct()
    member = member.select("field_name", "scope", "key", "raw", "form").join(changed, ["field_name", "scope", "form"], "left_semi")
    ways = member.select("field_name", "scope", "form", "raw").distinct()
    on = ["field_name", "scope", "form"]
    pairs = ways.withColumnRenamed("raw", "raw_a").join(ways.withColumnRenamed("raw", "raw_b"), on).where("raw_a < raw_b")
    left = member.withColumnsRenamed({"raw": "raw_a", "key": "a"})
    right = member.withColumnsRenamed({"raw": "raw_b", "key": "b"})
    found = pairs.join(left, [*on, "raw_a"]).join(right, [*on, "raw_b"]).where("a <> b")
    return found.select("field_name", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
