"""Problem 4: broken prompt-and-response pairs, by a multi-label linear classifier.

Hashed n-grams of the response and features of the pair (how much of the question the response copies, how it ends, in
what script it is written) are weighed for each defect. Training rows are made from sampled responses: truncated, replaced
by the question, by refusals and by texts in other languages; as they are, and with the question of another pair, they count
as sound. Thresholds are calibrated on held-out rows of the same making.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, Rows, bucket, calibrate
from .lookalike import form_of

#: Bounds of the sampled rows from which training pairs are made.
SAMPLE_RESPONSES, SAMPLE_FOREIGN, SAMPLE_PROMPTS, SEED = 4000, 2000, 1000, 42
#: Refusals that are made at least, however few responses are sampled.
LEAST_REFUSALS = 600
#: Defects in the order in which the first that applies is reported.
DEFECTS = ("empty", "copied", "refusal", "other_language", "truncated")
#: Defects whose wordings are learned from sampled responses, too: rounds of this, the scores from which one is clear, and from which it is in doubt.
OWN_WORDS, ROUNDS, CLEAR, DOUBT = ("refusal", "other_language"), 4, 0.6, 0.15

# Placeholders and notes of failed runs.
PLACEHOLDERS = [
    "", "-", "--", "...", "…", "n/a", "na", "none", "null", "nil", "nan", "undefined", "\"\"", "''", "{}", "[]", "()", ".", "?", "_", "*", "empty", "[empty]", "no answer", "no response", "no reason", "[no reason given]", "no reason given", "no reasoning provided", "no output", "(blank)", "blank", "tbd", "todo", "unknown", "error", "failed", "failure", "timeout", "timed out", "inference timed out", "inference failed", "generation failed", "model error", "model failed", "request failed", "request timed out", "run failed", "the run failed", "failed to parse", "parse error", "empty response", "empty response from model", "out of memory", "cuda out of memory", "skipped", "not available", "no explanation", "not generated", "[none]", "<empty>", "<null>", "<none>", "[timeout]", "[error]", "no content", "{\"reason\": \"\"}", "{\"reason\": null}", "```", "~",
]
# How a refusal starts and goes on; V what is declined, O its object.
REFUSALS = [
    "I can't V O", "I cannot V O", "I can not V O", "I won't V O", "I will not V O", "I am not able to V O", "I'm not able to V O", "I am unable to V O", "I'm unable to V O", "I must decline to V O", "I have to decline to V O", "I have to refuse to V O", "I refuse to V O", "I would rather not V O", "I'd rather not V O", "I'd prefer not to V O", "I prefer not to V O", "I am not comfortable enough to V O", "I do not feel comfortable to V O", "I don't feel able to V O", "I am not allowed to V O", "I'm not permitted to V O", "I don't think I should V O", "I choose not to V O", "I decline to V O", "I could not possibly V O", "it would be wrong for me to V O", "it is not appropriate for me to V O", "it is against my policy to V O", "my guidelines do not let me V O", "my rules forbid me to V O", "I can't help with O", "I cannot assist with O", "I can't comply with a request like this", "I will have to skip O", "O is not something that I can V", "O is something I don't V", "this is nothing that I may V", "your request is declined because O may hurt people", "this request is denied: O is not permitted", "O goes against my guidelines and gets no answer from me", "you will get no verdict from me on O",
]
# What may come before a refusal; none in many cases.
OPENERS = [
    "", "", "", "", "", "", "Sorry, ", "Sorry, but ", "I'm sorry, but ", "I am sorry, ", "Unfortunately, ", "Unfortunately ", "I am afraid ", "I'm afraid ", "To be honest ", "My apologies, ", "Apologies, but ", "As an AI language model ", "As an AI assistant, ", "As an AI ", "As a language model ", "Regrettably, ", "At this time ", "Well, ", "Thank you, but ",
]
# Reasons given for a refusal, and what may follow it.
REASONS = [
    "", "", "", "", " for safety reasons", " due to the content policy", " because it may be sensitive", " because it could be harmful", " without more context", " since it might offend someone", " as it goes against my guidelines", " under my rules",
]
TAILS = [
    "", "", "", " I hope you understand.", " Thank you for understanding.", " Please ask a human.", " Please try another one.", " Shall we talk about something else?", " It may be sensitive.", " Can I help with another picture?",
]
VERBS = ["explain", "describe", "discuss", "rate", "judge", "evaluate", "analyse", "analyze", "interpret", "comment on", "assess", "classify", "answer questions about", "help with", "process", "review", "give an opinion on", "decide about", "label"]
OBJECTS = ["this content", "this picture", "the caption", "this post", "images like this one", "this kind of joke", "material of this kind", "this meme", "posts of that sort", "the content", "this image", "such content", "this text", "the request", "that", "it", "jokes about people", "anything like this"]
# Short lead-ins of copied questions.
LEADS = [
    "", "", "", "", "The meme says ", "The caption says ", "Caption: ", "Question: ", "The text reads: ", "So, ", "ocr_text = ", "OCR: ", "Text: ", "The image text is: ", "It says ", "The prompt was: ", "Answer: ", "Here is the text: ", "Prompt: ", "The question is: ", "User: ",
]
# Closing remarks after a finished answer.
CLOSERS = [
    "", "", "", "", " (see notes.)", " (low confidence)", " [rule 3]", " 😂", " :)", "\nVerdict: humorous", "\nVerdict: not humorous", "\nScore: 7/10", "\nScore: 4", " Score: 8", "\n- humorous: yes", "\n- humorous: no", " (confidence 0.8)", " [1]", "\nScore: 0.7", " Score: 0.4", "\nFinal answer: humorous", " 👍", "\nLabel: 1", " #fun", "\nRating: 3/5",
]
# Frequent English words.
ENGLISH = frozenset(["the", "a", "an", "of", "to", "in", "is", "it", "and", "that", "for", "on", "with", "as", "at", "by", "this", "was", "are", "be", "its", "from", "not", "no", "or", "but", "so", "his", "her", "their", "they", "he", "she", "you", "i", "we", "which", "who", "what", "would", "could", "because", "while", "most", "when", "than", "then", "there", "has", "have", "had", "do", "does", "one", "all", "if", "any", "before", "after", "into", "about", "like", "just", "only", "also", "more", "very", "can", "will", "out", "up", "down", "over", "few", "my", "your", "our"])


#: The feature of a text that stops before its last sentence ends; `truncated` is checked against it.
STOPPED = "stopped"


class Pairs:
    """Features of response and question; one per Python worker."""

    def __init__(self):
        import regex

        v = regex.V1
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’]\p{L}+)?", v)
        self.bare = regex.compile(r"[\p{L}\p{M}\p{N}]+", v)
        self.quoted = regex.compile(r"\"[^\"\n]{0,400}\"|“[^”]{0,400}”|(?<!\w)'[^'\n]{2,200}'(?!\w)|«[^»]*»", v)
        closer = r"(?:\((?=[^()\n]{1,40}\)\s*\Z)[^()\n]*\)|\[[^\[\]\n]{1,30}\]|[\p{So}\p{Sk}‍️]+|[:;]-?[)D(P]|(?:\A|(?<=[\n.!?।。])\s*)[-*•]?\s*(?:verdict|score|final answer|answer|label|rating|humorous|confidence|prediction|result|conclusion)\s*[:=][^\n]{0,40}|#\w+)\s*\Z"
        self.closer = regex.compile(closer, v | regex.I)
        self.finished = regex.compile(r"[.!?।॥。！？۔؟]+[\"'”’»)\]*_`」』]*\s*\Z", v)
        self.fence = regex.compile(r"\A\s*```(?:json)?\s*|\s*```\s*\Z", v)
        self.asked: dict[str, list[str]] = {}

    def question(self, text: str) -> list[str]:
        """The words of a question; those of the last ones are kept, as many responses share a prompt."""
        if text not in self.asked:
            if len(self.asked) > 1000:
                self.asked.clear()
            self.asked[text] = self.bare.findall(form_of(text).lower())
        return self.asked[text]

    def unwrapped(self, text: str) -> tuple[str, str]:
        """The answer inside complete JSON, and what was found: 'json', 'broken' or ''."""
        t = self.fence.sub("", text).strip()
        at = t.find("{")
        if at < 0:
            return text, ""
        try:
            value, end = json.JSONDecoder(strict=False).raw_decode(t[at:])
        except ValueError:
            return text, "broken" if at == 0 or '"reason' in t[at : at + 60] else ""
        if not isinstance(value, dict) or t[at + end :].strip():
            return text, ""
        inner = [v for k, v in value.items() if isinstance(v, str) and k.lower() in ("reason", "reasoning", "explanation", "answer", "text", "response", "rationale")]
        if inner:
            return max(inner, key=len), "json"
        return (text, "") if value else ("", "json")

    def copies(self, words: list[str], q: list[str]) -> tuple[bool, float]:
        """Whether the words are a short lead-in and those of the question (or all but its last); the share of the question they hold."""
        if not q or not words:
            return False, 0.0
        for whole in (q, q[:-1]):
            lead = len(words) - len(whole)
            if whole and 0 <= lead <= 4 and words[lead:] == whole:
                return True, 1.0
        # a last word may be cut in itself
        if len(q) > 2 and 0 <= len(words) - len(q) <= 4 and words[-len(q) : -1] == q[:-1] and q[-1].startswith(words[-1]):
            return True, 1.0
        have = set(words)
        return False, sum(w in have for w in q) / len(q)

    def features(self, response: str | None, questions: list[str]) -> list[str]:
        text = form_of(response or "")
        inner, wrapped = self.unwrapped(text)
        short = " ".join(inner.split()).lower()
        f = ["1", "wrapped " + wrapped]
        if len(short) <= 40:
            f += ["whole " + short, f"letters {sum(c.isalpha() for c in short).bit_length()}"]
        bare = self.bare.findall(inner.lower())
        share, copied = 0.0, False
        for q in questions:
            if q:
                c, s = self.copies(bare, self.question(q))
                copied, share = copied or c, max(share, s)
        f += [f"copied {copied}", f"share {int(share * 5)}", f"share {int(share * 5)} long {len(bare) > 12}"]
        body = inner.rstrip()
        closed = False
        while m := self.closer.search(body):
            if m.start() == 0:
                break
            body, closed = body[: m.start()].rstrip(), True
        done = bool(self.finished.search(body)) and not body.endswith(("...", "…"))
        tail = body[-1:]
        kind = "letter" if tail.isalpha() else "digit" if tail.isdigit() else tail
        f += [f"done {done}", f"end {kind}", f"done {done} copied {copied}", f"done {done} wrapped {wrapped}", f"done {done} closed {closed}"]
        f += [STOPPED] if not done or wrapped == "broken" else []
        outside = self.quoted.sub(" ", inner)
        own = self.word.findall(outside.lower())
        latin = sum(w[0] < "ɐ" for w in own)
        english = sum(w in ENGLISH for w in own)
        n = max(1, len(own))
        letters = 0 if inner.isascii() else sum(c.isalpha() for c in inner)
        foreign = 0 if outside.isascii() else sum(c.isalpha() and c >= "ɐ" for c in outside)
        f += [f"script {min(3, int(4 * foreign / max(1, letters)))}", f"script {foreign > 0.5 * letters}"]
        f += [f"latin {int(4 * latin / n)}", f"english {min(6, int(20 * english / n))}", f"latin {int(4 * latin / n)} english {min(6, int(20 * english / n))}", f"n {min(8, len(own)).bit_length() if own else 0}"]
        f += ["u " + w for w in set(own)]
        f += [f"b {x} {y}" for x, y in zip(own, own[1:])]
        f += [f"t {x} {y} {z}" for x, y, z in zip(own, own[1:], own[2:])]
        head, last = own[:14], own[-4:]
        f += [f"h {x} {y}" for x, y in zip(head, head[1:])]
        f += [f"h3 {x} {y} {z}" for x, y, z in zip(head, head[1:], head[2:])]
        f += [f"e {x} {y}" for x, y in zip(last, last[1:])]
        if own:
            f += ["first " + own[0], f"last {own[-1]} {done}"]
        return f

    def hashed(self, response: str | None, questions: list[str]) -> np.ndarray:
        return np.unique(np.fromiter((bucket(x) for x in self.features(response, questions)), np.int64))


def training_rows(rng: np.random.Generator, good: list[tuple[str, str]], foreign: list[str], prompts: list[str]):
    """(response, questions, defect or None) made from sound (response, question) pairs and texts in other languages."""

    def pick(some: list[str]) -> str:
        return some[int(rng.integers(len(some)))]

    def refusal() -> str:
        s = pick(OPENERS) + pick(REFUSALS).replace(" V", " " + pick(VERBS)).replace(" O", " " + pick(OBJECTS)) + pick(REASONS) + "." + pick(TAILS)
        return s if rng.random() < 0.9 else json.dumps({"reason": s})

    out = []
    for r, q in good:
        qs = [q, pick(prompts) if prompts else ""]
        out.append((r + pick(CLOSERS), qs, None))
        if rng.random() < 0.2:
            # an answer to another question is no defect of the kinds that are told apart here
            out.append((r, [good[int(rng.integers(len(good)))][1], qs[1]], None))
        if rng.random() < 0.15:
            out.append((json.dumps({"humorous": True, "reason": r}, ensure_ascii=False), qs, None))
        u = rng.random()
        if u < 0.35 and len(r) > 60:
            cut = r[: int(len(r) * rng.uniform(0.35, 0.97))].rstrip(" .!?")
            if rng.random() < 0.4:
                cut = cut.rsplit(" ", 1)[0] + pick(["", "", " because the", " and", " of", " with the…", "…", "...", " (", ",", " which is", " so"])
            if rng.random() < 0.15:
                cut = '{"reason": "' + cut
            if rng.random() < 0.1:
                cut += pick(["\nVerdict: humorous", "\nScore: 4/10"])
            out.append((cut, qs, "truncated"))
        elif u < 0.6:
            base = q if rng.random() < 0.75 or not prompts else qs[1]
            if foreign and rng.random() < 0.3:
                base = pick(foreign)
                qs = [base, qs[1]]
            words = base.split(" ")
            text = " ".join(words[:-1] if rng.random() < 0.3 and len(words) > 4 else words)
            text = text.upper() if rng.random() < 0.2 else text.lower() if rng.random() < 0.2 else text
            text = text.replace("\n", str(rng.choice([" ", " / ", "\n"])))
            quote = str(rng.choice(["", '"', "'"]))
            out.append((pick(LEADS) + quote + text + quote, qs, "copied"))
        elif u < 0.8:
            # some refuse after sentences of an answer
            first = r[: r.find(". ") + 2] if rng.random() < 0.15 and ". " in r else ""
            out.append((first + refusal(), qs, "refusal"))
        elif u < 0.9:
            out.append((pick(PLACEHOLDERS) + pick(["", "", " ", "\n"]), qs, "empty"))
        if foreign and rng.random() < 0.5:
            t = pick(foreign)
            t = t[: int(rng.integers(12, 241))] if rng.random() < 0.5 else t
            t = t if rng.random() < 0.8 else json.dumps({"reason": t}, ensure_ascii=False)
            out.append((t, qs, "other_language"))
    for _ in range(sum(x[2] == "refusal" for x in out), LEAST_REFUSALS):
        out.append((refusal(), [good[int(rng.integers(len(good)))][1] if good else "", pick(prompts) if prompts else ""], "refusal"))
    return out


def train(good: list[tuple[str, str]], foreign: list[str], prompts: list[str]) -> tuple[dict[int, tuple], list[float]]:
    """(weights of all defects by bucket, thresholds)."""
    rng = np.random.default_rng(SEED)
    pairs = Pairs()
    made = training_rows(rng, good, foreign, prompts)
    rows = Rows([pairs.hashed(r, q) for r, q, _ in made])
    held = rng.random(len(made)) < 0.2
    models, cuts = [], []
    sampled = np.array([x[2] is None for x in made])
    epochs = max(4, 20_000 // len(made))  # small samples are gone through more often
    for d in DEFECTS:
        y = np.array([x[2] == d for x in made], float)
        # a later defect is not held against an earlier one: other rows that are defective count as negative all the same
        m = Ftrl(alpha=0.2, l1=0.3).fit(rows, y, ~held * 1.0, epochs=epochs // 2, batch=32)
        for _ in range(ROUNDS if d in OWN_WORDS else 1):
            # sampled responses are not all sound: those that look defective are left out, clear ones of a kind with wordings of its own teach them
            s = m.scores(rows)
            clear = sampled & (s >= CLEAR) if d in OWN_WORDS else sampled & False
            noisy = sampled & (s > (DOUBT if d in OWN_WORDS else 0.5))
            m = Ftrl(alpha=0.2, l1=0.3).fit(rows, np.maximum(y, clear), (~held & (~noisy | clear)) * 1.0, epochs=epochs, batch=32)
        at = np.flatnonzero(held & ~noisy)
        cuts.append(calibrate(m.scores(rows)[at], y[at] > 0) if len(at) else 0.5)
        models.append(m.compact())
    keys = sorted(set().union(*models))
    return {k: tuple(m.get(k, 0.0) for m in models) for k in keys}, cuts


def fit(results: DataFrame, prompts: DataFrame, documents: DataFrame) -> tuple[dict[int, tuple], list[float]]:
    """Train on bounded samples, picked by a hash: responses that end in a full stop, and documents not in English."""
    order = F.xxhash64(F.lit(SEED), "result_id")
    good = results.where("reasoning is not null and ocr_text is not null and json_error is null and length(reasoning) between 20 and 600 and reasoning rlike '[.!]$'")
    good = good.select("result_id", "reasoning", "ocr_text").orderBy(order, "result_id").limit(SAMPLE_RESPONSES).collect()
    other = documents.where("lang is not null and lang <> 'en' and length(text) between 40 and 2000").select("doc_id", F.col("text").alias("t"))
    other = other.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE_FOREIGN).collect()
    texts = [r.prompt_text for r in prompts.select("prompt_text").dropna().orderBy(F.xxhash64("prompt_text"), "prompt_text").limit(SAMPLE_PROMPTS).collect()]
    return train([(r.reasoning, r.ocr_text) for r in good], [" ".join(r.t.split()) for r in other], texts)


def defects(pairs: DataFrame, key: str, response: str, questions: list[str], model) -> DataFrame:
    """pairs -> (key, defect, score): the first defect of each pair that reaches its threshold; sound pairs give no row.

    A null or blank response is `empty`; null questions are ignored; repeated rows give repeated rows.
    """
    import pyarrow as pa

    sent = pairs.sparkSession.sparkContext.broadcast(model)
    kind = pairs.schema[key].dataType.simpleString()

    def run(it):
        weights, cuts = sent.value
        zero = (0.0,) * len(DEFECTS)
        p = Pairs()
        logits = [float(np.log(c / (1 - c))) if 0 < c < 1 else 0.0 for c in cuts]
        for b in it:
            keys, kinds, scores = [], [], []
            cols = [c.to_pylist() for c in b.columns[1:]]
            for i, (r, *qs) in enumerate(zip(*cols)):
                if r is None or not r.strip():
                    keys.append(i), kinds.append("empty"), scores.append(1.0)
                    continue
                found = set(p.features(r, qs))
                s = np.array([weights.get(bucket(x), zero) for x in found]).sum(axis=0)
                for d, x, c in zip(DEFECTS, s, logits):
                    if x >= c and (d != "truncated" or STOPPED in found):
                        keys.append(i), kinds.append(d), scores.append(float(1 / (1 + np.exp(-x))))
                        break
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int32())), pa.array(kinds, pa.string()), pa.array(scores, pa.float64())], names=[key, "defect", "score"])

    return pairs.select(key, response, *questions).mapInArrow(run, f"`{key}` {kind}, defect string, score double")
