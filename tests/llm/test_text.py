"""Normalisation, encoding, sentences, languages, abuse and pair defects."""

import itertools
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import abuse, langid, pairs, sentences, tokens
from quillmark.llm.lookalike import lookalike_pairs, mapping, with_canonical


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.canon for r in with_canonical(df, "t").orderBy("i").collect()]


def direct(t):
    return None if t is None else unicodedata.normalize("NFC", t.translate(mapping()))


CASES = ["café ﬁne ｙａｎ", "a​b\xa0c", "Нareliyan", "क़्", "क़", "한글", "한글", None, "", "  ", "q̣́ q̣́", "ো", "ো", "ভাড়া ও ভাড়া", "x" * 200_000, "é" * 50_000, "ａ", "ａ", "́start", "😂 👨‍👩‍👧", "e\u0301\u093c", "a\u0323\u093c\u0302\u0301"]


def test_forms_equal_the_direct_computation(spark):
    assert forms(spark, CASES) == [direct(t) for t in CASES]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="aȩ়́́ােড\xa0​ѕＡ ﬁ\nक़़्", max_size=25), min_size=1, max_size=15))
def test_forms_of_random_texts(spark, texts):
    assert forms(spark, texts) == [direct(t) for t in texts]


def test_lookalike_pairs_and_clashing_columns(spark):
    rows = [("f", "", 1, "café", 1), ("f", "", 2, "caf\xe9", 1), ("f", "", 3, "caf\xe9", 1), ("f", "", 4, "cafe", 1), ("f", "x", 5, "café", 1), ("f", "", 6, None, 1), ("f", "", 7, " ", 1), ("f", "", 8, "\xa0", 1), ("f", "", 1, "café", 2)]
    df = spark.createDataFrame(rows, "field_name string, scope string, key long, text string, ingested_at int").withColumn("canon", F.lit(1)).withColumn("piece", F.lit("p"))
    assert {(r.key_a, r.key_b) for r in lookalike_pairs(df).collect()} == {(1, 2), (1, 3)}
    assert lookalike_pairs(df.limit(0)).count() == 0


ENCODED = ["Hello world's  end\n", "नमस्ते दुनिया", "", None, "  ", "<|endoftext|> x", "a" * 5000, "b " * 20_000, "😂" * 600, "aaab" * 300, "中文" * 400, "tab\tand\r\nline"]


def test_ids_equal_the_library(spark):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    df = spark.createDataFrame([*enumerate(ENCODED), (0, ENCODED[0])], "doc_id long, text string").withColumn("ids", F.lit(0))
    rows = tokens.encode_corpus(df, "doc_id", "text").collect()
    assert len(rows) == len(ENCODED) + 1
    for r in rows:
        assert r.ids == t.encode(ENCODED[r.doc_id] or "", add_special_tokens=False).ids
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    n = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, "doc_id", "text", count_only=True).collect()}
    assert n[2] == n[3] == 0
    back = {(r.doc_id, r.text) for r in tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {(i, t or "") for i, t in enumerate(ENCODED)}


SENTENCES = [
    ("Dr. Rao came at 10.30 a.m. and left. He paid Rs. 42!", ["Dr. Rao came at 10.30 a.m. and left.", "He paid Rs. 42!"]),
    ("A heading\n\nIt was filmed at 7 p.m. One day\npassed.", ["A heading", "It was filmed at 7 p.m.", "One day\npassed."]),
    ('"Is this it?" asked Ann. Bob said, "It is muddy." A cat left.', ['"Is this it?" asked Ann.', 'Bob said, "It is muddy."', "A cat left."]),
    ("डॉ. राव आए थे | वह गया। \"कहाँ है?\" उसने पूछा।", ["डॉ. राव आए थे |", "वह गया।", "\"कहाँ है?\" उसने पूछा।"]),
    ("他走了。“在哪里？”她问道。请看第2.1节！", ["他走了。", "“在哪里？”她问道。", "请看第2.1节！"]),
    ("1. First point. 2. Second point. K. L. Rao spoke.", ["1. First point.", "2. Second point.", "K. L. Rao spoke."]),
    ("See memes.Vana.example/page.html or version 2.0.1 now. No mark", ["See memes.Vana.example/page.html or version 2.0.1 now.", "No mark"]),
    ("یہ ٹھیک ہے۔ کیا؟", ["یہ ٹھیک ہے۔", "کیا؟"]),
    ("Well... it was calm, wasn't it?! Yes.", ["Well... it was calm, wasn't it?!", "Yes."]),
    ("He said no. She left early.", ["He said no.", "She left early."]),
    ("I ran 10 km. Then I slept. See no. 7 and fig. 2 there.", ["I ran 10 km.", "Then I slept.", "See no. 7 and fig. 2 there."]),
    ("Smt. Rao ne kaha ki yeh hai. Woh nahi gaya. Rs. 40 ka tha.", ["Smt. Rao ne kaha ki yeh hai.", "Woh nahi gaya.", "Rs. 40 ka tha."]),
    ("The answer is su. Nobody knows the reason. Dr. Rao was here.", ["The answer is su.", "Nobody knows the reason.", "Dr. Rao was here."]),
    ("Is it near Tolka?This is new.", ["Is it near Tolka?", "This is new."]),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(90, None), (91, ""), (92, " \n ")], "doc_id long, text string")
    rows = sentences.sentence_ends(df, spans=True).orderBy("doc_id", "sent_no").collect()
    got = {i: [r.sentence for r in rows if r.doc_id == i] for i in range(len(SENTENCES))}
    assert got == {i: s for i, (_, s) in enumerate(SENTENCES)}
    assert not any(r.doc_id >= 90 for r in rows)
    for i, (t, _) in enumerate(SENTENCES):
        assert [r.sent_end for r in rows if r.doc_id == i][-1] == len("".join(t.split()))


def test_long_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "A b. " * 20_000), (1, "A b. " * 20_000), (2, "x" * 100_000)], "doc_id long, text string").withColumn("sent_end", F.lit(0))
    n = {r.doc_id: r["count"] for r in sentences.sentence_ends(df).groupBy("doc_id").count().collect()}
    assert n == {1: 40_000, 2: 1}


EN = ["when the train from the city says the office is late", "my mother asked why the teacher lost the book again", "how i look at the printer after ten days of waiting", "nobody in the town believes that the cat is famous"]
HL = ["mera dost kal office mein kho gaya aur kisi ne nahi poocha", "tumhara chai kabhi thanda nahi hota sirf subah", "log kehte hain mota pyaaz accha hota hai dobara", "jab hamara kutta bola ki gaadi bahut aalsi hai"]
HI = ["मेरा दोस्त कल दफ्तर में खो गया और किसी ने नहीं पूछा", "तुम्हारा चाय कभी ठंडा नहीं होता सिर्फ सुबह", "लोग कहते हैं मोटा प्याज अच्छा होता है"]


def test_languages(spark):
    train = [("en", t) for t in EN * 10] + [("hi-Latn", t) for t in HL * 10] + [("hi", t) for t in HI * 10]
    counts = langid.counts_of(spark.createDataFrame(train, "lang string, text string"))
    texts = [EN[0] + "\n" + EN[1], HL[0], HI[0] + "\n@some_page", EN[2] + "\n" + HI[1], None, "", "12 34", HL[1] + "\n" + HL[2]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").withColumn("lang_code", F.lit(1))
    rows = {r.k: r for r in langid.languages(df, "t", counts).collect()}
    assert [rows[i].lang_code for i in range(8)] == ["en", "hi-Latn", "hi", "mul", None, None, None, "hi-Latn"]
    assert {s.lang for s in rows[3].segments} == {"en", "hi"} and rows[0].confidence > 0.9
    labels = ["en", "English", "", "hi", None, None, None, "HI_latn"]
    memes = spark.createDataFrame([(i, t, labels[i]) for i, t in enumerate(texts)], "k long, t string, lab string")
    wrong = langid.languages(memes.withColumn("enough", langid.enough_pieces("t")), "t", counts).where(F.col("enough") & langid.is_wrong("lab")).collect()
    assert {(r.k, r.lang_code) for r in wrong} == {(1, "hi-Latn"), (2, "hi"), (3, "mul")}


def test_abuse(spark):
    # opinions about whole texts: most texts with an abusive line are called offensive, a few others are, too
    rng = np.random.default_rng(3)
    names = ["".join(x).capitalize() for x in itertools.product(["va", "so", "re", "mi", "ta"], ["na", "lu", "ka", "ro", "ni"], ["", "sh", "nd", "r"])]
    pick = lambda xs: str(rng.choice(xs))
    bad = [lambda: f"what a bastard, I hope {pick(names)} rots in {pick(names)}pur", lambda: f"all {pick(names)} people are vermin, throw them out of {pick(names)}pur"]
    good = [lambda: f"when my {pick(['train', 'cat', 'phone'])} from the city says the {pick(names)} is {pick(['late', 'loud'])}", lambda: f"all mosquitoes are vermin, throw them out of {pick(names)}pur, begs {pick(names)}"]
    rows = []
    for i in range(8000):
        abusive = rng.random() < 0.1
        lines = [good[int(rng.integers(2))]() for _ in range(2)] + ([bad[int(rng.integers(2))]()] if abusive else [])
        rows.append((i, "\n".join(lines), "very_offensive" if rng.random() < (0.72 if abusive else 0.14) else "not_offensive"))
    w = abuse.fit(spark.createDataFrame(rows, "row_id long, ocr string, offensive string"))
    texts = {1: "what a b.a.s.t.a.r.d, I hope Vana rots in Solapur", 2: "all mosquitoes are vermin, throw them out of Solapur, begs Vana", 3: "nice day\nall Pelari people are vermin, throw them out of Vanapur", 4: None, 5: "", 6: "12 !!", 7: "when my train from the city says the boss is late", 8: "word " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "k long, t string").withColumn("score", F.lit("x"))
    got = {r.k: r.score for r in abuse.scores(df, "t", w).collect()}
    assert {k for k, s in got.items() if s >= abuse.THRESHOLD} == {1, 3}
    assert got[4] == got[5] == 0.0
    sources = df.where("k < 4").withColumn("source", F.element_at(F.array(F.lit("A b"), F.lit("a_b"), F.lit(None)), F.col("k").cast("int")))
    rates = {r.source_key: (r.n_texts, r.n_abusive) for r in abuse.rates(abuse.scores(sources, "t", w), "source").collect()}
    assert rates == {"a_b": (2, 1), "": (1, 1)}


def test_abuse_without_labels(spark):
    w = abuse.fit(spark.createDataFrame([(1, "some text", None), (2, None, "very_offensive")], "row_id long, ocr string, offensive string"))
    df = spark.createDataFrame([(1, "you are a bastard"), (2, "the word bastard is rude"), (3, "we met at the station")], "k long, t string")
    got = {r.k for r in abuse.scores(df, "t", w).collect() if r.score >= abuse.THRESHOLD}
    assert got == {1}


def test_disguised_words():
    assert abuse.words_of("you b.a.s.t.a.r.d and k***e, kutttte $lut @handle")[:2] == ["you", "bastard"]
    assert "kutte" in abuse.words_of("kutttte") and "slut" in abuse.words_of("$lut")


def test_pair_defects(spark):
    good = [(f"The joke depends on the {a} of {b}, which creates an absurd mismatch. The viewer expects a {c} but gets the {a}.", f"when my {a} says the {b} is {c} again and nobody asked the old uncle why") for a in ("train", "lamp", "coin", "boat", "drum") for b in ("Vana", "Solu", "Reka", "Milo") for c in ("calm", "late", "loud", "odd", "shy")]
    foreign = [t for t in HI + HL + ["এই ছবিতে ছবি বড় আর ফোন ও বাঁকা।", "这个模板最早用来讽刺生气的书包。"]] * 8
    prompts = ["Look at the picture and decide whether it is humorous for a typical viewer."]
    model = pairs.train(good, foreign, prompts)
    q = "kal mera dost office mein kho gaya aur kisi ne nahi poocha phir se"
    rows = {
        1: (good[0][0], None), 2: (None, "empty"), 3: (" ", "empty"), 4: ("N/A", "empty"), 5: (q, "copied"), 6: ('The meme says "' + q.upper() + '"', "copied"), 7: ("I'm sorry, but I can't explain this picture.", "refusal"),
        8: (HI[0] + "। " + HI[1] + "।", "other_language"), 9: (good[3][0][:95], "truncated"), 10: ('{"humorous": true, "reason": "' + good[1][0] + '"}', None), 11: (good[2][0] + "\nVerdict: humorous", None), 12: (prompts[0], "copied"),
    }
    df = spark.createDataFrame([(k, r, q, prompts[0]) for k, (r, _) in rows.items()], "k long, r string, q string, p string")
    got = {r.k: r.defect for r in pairs.defects(df, "k", "r", ["q", "p"], model).collect()}
    assert got == {k: d for k, (_, d) in rows.items() if d}
    assert pairs.defects(df.limit(0), "k", "r", ["q"], model).count() == 0
