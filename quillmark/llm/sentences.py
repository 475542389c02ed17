"""Problem 10: sentence boundaries across languages and scripts.

Boundaries follow the standard sentence-break properties of characters (terminators of all scripts, closing marks, case
of what follows), with the abbreviations of the paragraph's language suppressed and quotations kept inside their sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Abbreviations that never end a sentence, by language; lower-cased, without the final full stop.
ABBREVIATIONS = {
    "en": ["mr", "mrs", "ms", "dr", "prof", "st", "sr", "jr", "vs", "i.e", "e.g", "cf", "viz", "rev", "gen", "col", "capt", "lt", "sgt", "hon", "mt", "messrs", "mme", "mlle", "approx", "dept", "est"],
    "hi-Latn": ["shri", "smt", "dr", "prof", "pt", "kum", "su", "adv", "mr", "mrs", "ms"],
    "hi": ["डॉ", "श्री", "श्रीमती", "सुश्री", "प्रो", "रु", "पं", "कु", "मो", "सं", "क्र", "पृ"],
    "mr": ["डॉ", "श्री", "सौ", "प्रा", "रु", "कु", "सं", "क्र", "पृ"],
    "bn": ["ডা", "ড", "মো", "মোঃ", "শ্রী", "শ্রীমতী", "প্রফেসর", "অধ্যাপক", "রু", "টা", "নং", "পৃ"],
    "ta": ["டாக்டர்", "திரு", "திருமதி", "செல்வி", "ரூ", "பேரா", "எண்", "பக்"],
    "ur": ["ڈاکٹر", "جناب", "پروفیسر"],
}
# Abbreviations only before a number; elsewhere they are words, or end a sentence.
BEFORE_NUMBERS = {"en": ["no", "nos", "fig", "figs", "vol", "p", "pp", "ch", "sec", "eq", "ca", "op", "art", "rs"], "hi-Latn": ["rs", "no", "nos", "km", "kr", "p", "pp", "fig"]}
# Frequent words by which languages of one script are told apart.
FREQUENT = {
    "en": ["of", "and", "was", "in", "that", "it", "for", "on", "with", "as", "at", "by", "are", "this", "he", "she", "they", "an", "his", "her", "not", "from", "who", "which", "has", "had", "said", "my", "your", "our"],
    "hi-Latn": ["hai", "ka", "ki", "ke", "ko", "mein", "nahi", "aur", "se", "par", "hain", "tha", "thi", "ne", "bhi", "yeh", "woh", "kya", "ek", "toh", "hi", "jo", "kuch", "liye", "gaya", "raha", "rahi", "mera", "tum", "hum"],
    "hi": ["है", "का", "की", "के", "को", "में", "नहीं", "और", "से", "पर", "हैं", "था", "थी", "ने", "भी", "यह", "वह", "क्या", "एक"],
    "mr": ["आहे", "आणि", "नाही", "च्या", "चा", "ची", "चे", "ला", "मध्ये", "होते", "होता", "होती", "या", "ते", "ती", "तो", "हे", "ही", "काय"],
}
# Abbreviations that end a sentence only where a new one visibly starts.
SOMETIMES = "a.m p.m etc inc ltd co corp u.s u.k ph.d b.a m.a jan feb mar apr jun jul aug sep sept oct nov dec"
# Quotation marks that open and close; the straight mark does both.
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "＂": "＂", "‘": "’", "‹": "›", "《": "》"}

NEVER = {lang: frozenset(ws) for lang, ws in ABBREVIATIONS.items()}
NUMBERED = {lang: frozenset(ws) for lang, ws in BEFORE_NUMBERS.items()}
ANY = frozenset().union(*NEVER.values(), *NUMBERED.values())
COMMON = {lang: frozenset(ws) for lang, ws in FREQUENT.items()}
MAYBE = frozenset(SOMETIMES.split())


class Splitter:
    """Finds ends of sentences; one per Python worker."""

    def __init__(self):
        import regex

        v = regex.V1
        self.paragraph = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\n\r ]*(?:(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\n\r ]*)+| ", v)
        # a bar with a blank before it stands for a danda in scripts that have one
        self.mark = regex.compile(r"(?:[\p{SB=STerm}\p{SB=ATerm}…‥‼⁇-⁉﹖﹗][\p{Mn}\p{Cf}]*)+|(?<=[\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Nd}\p{Pe}\p{Pf}\"'][^\S\n\r]?)\|{1,2}(?=\s|$|[\p{Pf}\p{Pe}\"'])", v)
        self.close = regex.compile(r"[\p{Pe}\p{Pf}\"'＂’”»]*", v)
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}.']*[\p{L}\p{M}\p{N}])?\Z", v)
        self.list_number = regex.compile(r"\s*[\p{Pi}\p{Ps}\"'*•\-–]*\s*(?:\p{Nd}{1,3}|[ivxIVX]{1,4}|[A-Za-z])\Z", v)
        self.line_number = regex.compile(r"(?:^|[\n\r ])[^\S\n\r]*[\p{Ps}]?(?:\p{Nd}{1,3}|[ivx]{1,4}|[A-Za-z])\Z", v)
        self.space = regex.compile(r"\s*", v)
        self.blank = regex.compile(r"\s+", v)
        self.letter = regex.compile(r"\p{L}", v)
        self.lower = regex.compile(r"\p{Ll}", v)
        self.upper = regex.compile(r"[\p{Lu}\p{Lt}]", v)
        self.ends_word = regex.compile(r"[\p{L}\p{M}\p{N}]", v)
        self.address = regex.compile(r"[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)*(?:\.\p{Ll}{2,}(?![\p{L}])|/)", v)
        self.number = regex.compile(r"[\p{Nd}#]", v)
        self.words = regex.compile(r"[\p{L}\p{M}]+", v)
        self.scripts = [(regex.compile(rf"\p{{{name}}}", v), langs) for name, langs in (("Latin", ("en", "hi-Latn")), ("Devanagari", ("hi", "mr")), ("Bengali", ("bn",)), ("Tamil", ("ta",)), ("Arabic", ("ur",)))]
        self.inner = regex.compile(r"[\p{Ps}\p{Pi}\"'＂*_]*", v)

    def ends(self, text: str | None) -> list[int]:
        """Places (in characters) where the sentences of text end; none for null and blank texts."""
        out: list[int] = []
        if not text or not text.strip():
            return out
        at = 0
        for m in [*self.paragraph.finditer(text), None]:
            to = m.start() if m else len(text)
            self._paragraph(text, at, to, out)
            at = m.end() if m else to
        return out

    def _quotes(self, text: str, at: int, to: int) -> list[tuple[int, int]]:
        """Spans of quotations in a paragraph, from the opening mark to after the closing one; unclosed ones are none."""
        spans, stack = [], None
        for i in range(at, to):
            ch = text[i]
            if stack is not None:
                if ch in QUOTES[text[stack]] and not (ch in "’" and i + 1 < to and self.letter.match(text[i + 1])):
                    spans.append((stack, i + 1))
                    stack = None
                continue
            if ch in QUOTES:
                if ch in '"＂' and i > at and text[i - 1].isdigit() and not (i + 1 < to and self.letter.match(text[i + 1])):
                    continue  # a sign of inches
                close = [text.find(q, i + 1, to) for q in QUOTES[ch]]
                if max(close) >= 0:
                    stack = i
        return spans

    def _languages(self, text: str, at: int, to: int, word: str) -> tuple[str, ...]:
        """The language of a paragraph, among those of the script of a word in it; where its frequent words don't tell, that of the text, else all of them."""
        langs = next((langs for script, langs in self.scripts if script.match(word)), ())
        if len(langs) > 1:
            for part in (text[at:to], text):
                ws = self.words.findall(part.lower())
                votes = [sum(w in COMMON[lang] for w in ws) for lang in langs]
                if votes.count(max(votes)) == 1:
                    return (langs[votes.index(max(votes))],)
        return langs

    def _paragraph(self, text: str, at: int, to: int, out: list[int]) -> None:
        quotes = self._quotes(text, at, to)
        q = 0
        begin = self.space.match(text, at, to).end()
        pos = token = begin
        while m := self.mark.search(text, pos, to):
            for blank in self.blank.finditer(text, pos, m.start()):
                token = blank.end()
            pos = m.end()
            while q < len(quotes) and quotes[q][1] <= m.start():
                q += 1
            quote = quotes[q] if q < len(quotes) and quotes[q][0] < m.start() else None
            end = self.close.match(text, pos, to).end()
            if quote:
                if pos < quote[1] - 1 or quote[1] > end:
                    continue  # inside a quotation that goes on
                end = max(quote[1], pos)
                after_quote = self.close.match(text, end, to).end()
                end = after_quote
            elif end > pos and text[pos] in '"＂' and any(a == pos for a, _ in quotes):
                end = pos  # the mark opens a new quotation
            elif end > pos and any(pos < a < end for a, _ in quotes):
                end = min(a for a, _ in quotes if pos < a < end)
            follow = self.space.match(text, end, to).end()
            if follow < to and self._goes_on(text, (at, to), max(begin, token), begin, m, end, follow, quote):
                continue
            out.append(end)
            begin = pos = follow
        tail = text[begin:to].rstrip()
        if tail:
            if out and begin > at and not self.ends_word.search(tail) and all(c in "\"'”’»)]" for c in tail):
                out[-1] = begin + len(tail)
            else:
                out.append(begin + len(tail))

    def _goes_on(self, text, paragraph, token, begin, m, end, follow, quote) -> bool:
        """Whether the sentence goes on after the mark m, whose closing marks end at `end` and whose blanks end at `follow`; the mark's token starts at `token`."""
        to = paragraph[1]
        marks, gap = m.group(), follow > end
        nxt = self.inner.match(text, follow, to).end()
        ch = text[nxt] if nxt < to else ""
        if text[follow] in ",;:،؛、，；：–—" or text[follow] == "-" and not gap:
            return True
        stop = marks[-1] in ".．․" and "?" not in marks and "!" not in marks
        dots = "…" in marks or "..." in marks
        before = self.word.search(text, token, m.start())
        if quote:
            if self.lower.match(ch):
                return True
            if quote[0] <= self.inner.match(text, begin, to).end() and quote[0] - begin <= 1:
                return True  # the sentence began with the quotation: who said it follows
            lead = text[begin : quote[0]].rstrip()
            return not (lead and lead[-1] in ",:،，：" or self.upper.match(ch))
        if stop and not dots:
            if not gap and ch and (ch.isdigit() and before or not self.letter.match(ch) and ch not in "\"“‘'(" and not ch.isdigit()):
                return True
            if self.list_number.fullmatch(text, begin, m.start()) or before and len(before.group()) <= 4 and self.line_number.search(text, max(begin, text.rfind("\n", begin, m.start()), text.rfind("\r", begin, m.start()), text.rfind("\u2028", begin, m.start())), m.start()):
                return True
            if before:
                w = before.group().lower()
                for x in {w, w.split("'")[-1]} & ANY:
                    for lang in self._languages(text, *paragraph, x):
                        if x in NEVER[lang] or x in NUMBERED.get(lang, ()) and self.number.match(text, follow):
                            return True
                if w in MAYBE:
                    return not (gap and (self.upper.match(ch) or not self.lower.match(ch) and self.letter.match(ch) and not ch.isascii()))
                if len(w) == 1 and self.upper.match(before.group()) and w.isascii():
                    return True  # an initial
                if "." in w and all(len(x) == 1 for x in w.split(".")) and not (gap and self.upper.match(ch)):
                    return True
            if self.lower.match(ch) and text[follow] not in QUOTES:
                return True
            if not gap and self.address.match(text, follow, to):
                return True
            if not gap:
                # no blank: only where a lower-cased or caseless word meets a new beginning
                return not (before and len(before.group()) > 1 and (self.upper.match(ch) and self.lower.match(text[m.start() - 1]) or ch in "\"“‘'(" or self.letter.match(ch) and not ch.isascii() and not self.upper.match(ch)))
            return False
        if dots:
            if self.lower.match(ch):
                return True
            if self.upper.match(ch):
                return False
            return len(text[begin : m.start()].split()) <= 2
        return False

    def counts(self, text: str | None, ends: list[int]) -> list[int]:
        """Ends as numbers of characters other than white space from the start of the text."""
        out, at, n = [], 0, 0
        for e in ends:
            n += e - at - sum(len(b) for b in self.blank.findall(text, at, e))
            at = e
            out.append(n)
        return out


_splitter: list[Splitter] = []


def sentence_ends(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """docs -> (key, sent_end long), one row per sentence; with spans (key, sent_no int, sentence string, sent_end).

    Null and blank texts give no row. Repeated rows give repeated rows; other columns of docs are ignored.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(it):
        if not _splitter:
            _splitter.append(Splitter())
        split = _splitter[0]
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                row, ends, number, texts = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = split.ends(t)
                    row += [i] * len(found)
                    ends += split.counts(t, found)
                    if spans:
                        start = 0
                        for n, e in enumerate(found, 1):
                            number.append(n)
                            texts.append(t[start:e].strip())
                            start = e
                keys = part.column(0).take(pa.array(row, pa.int32()))
                cols, names = [keys, pa.array(ends, pa.int64())], [key, "sent_end"]
                if spans:
                    cols, names = [keys, pa.array(number, pa.int32()), pa.array(texts, pa.string()), cols[1]], [key, "sent_no", "sentence", "sent_end"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {kind}, " + ("sent_no int, sentence string, sent_end long" if spans else "sent_end long")
    return docs.select(key, text).mapInArrow(run, schema)
