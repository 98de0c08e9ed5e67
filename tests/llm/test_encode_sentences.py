"""Encoding against the tokenizer itself, round trips, and sentence rules."""

import random

import pytest
from pyspark.sql import functions as F

from textweir.llm.encode import EncodeSpec, _own_words, decode, doubtful_characters, encode, encode_word, in_doubt, split_words, token_counts, word_table
from textweir.llm.sentences import sentences
from textweir.llm.tokenizers import load

TEXTS = [
    None, "", " ", "hello world", "Hello  world \n\n it's  we'll", "naïve café 漢字 かな ไทย हिन्दी العربية", "😀👩‍🏫 é  　x", "<|endoftext|> is text",
    "a" * 3000, "\t\r\n  \r\n", "x y﻿", "word " * 2000, "3.14 1,000 v2", "hello world",
]


@pytest.mark.parametrize("share", [0.0005, 1.0, 0.02])
def test_ids_are_the_tokenizers_own(spark, share):
    spec = EncodeSpec(hot_share=share)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "repeated id"), (None, "null id"), (7, TEXTS[7]), (7, TEXTS[7]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as uid", "'w' as word", "2 as ids", "3 as parts")
    out = [(r["id"], list(r["ids"])) for r in encode(df, "id", "text", spec).collect()]
    tok = load(spec.path)
    want = [(i, tok.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert encode(df.limit(0), "id", "text", spec).count() == 0
    counts = sorted(((r["id"], r["n_tokens"]) for r in token_counts(df, "id", "text", spec).collect()), key=repr)
    assert counts == sorted(((i, len(x)) for i, x in want), key=repr)
    assert token_counts(df.limit(0), "id", "text", spec).count() == 0


def test_words_are_the_tokenizers_own():
    path = EncodeSpec().path
    rng = random.Random(5)
    pools = ["abc 12.,'\n", "éßñ'sltre ", "漢字かなไทย ١٢٣", "\u0300\u200d\ufeff\u00a0 x1", "".join(map(chr, range(0x20, 0x3000)))]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in [rng.randrange(0x30000) for _ in range(30)] if not 0xD800 <= c < 0xE000) for _ in range(500)]
    for t in texts:
        assert split_words(path, t) == _own_words(path, t) and "".join(split_words(path, t)) == t
    tok = load(path)
    assert all([i for w in split_words(path, t) for i in encode_word(path, w)] == tok.encode(t, add_special_tokens=False).ids for t in texts[:800])
    odd = doubtful_characters(path)
    assert in_doubt("\U00020000", odd) and not in_doubt("plain é 漢 😀", odd)


def test_round_trip_and_single_encoding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    back = {r["id"]: r["text"] for r in decode(encode(df, "id", "text"), "id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    table = word_table(df, "text")
    assert table.count() == table.select("word").distinct().count()
    assert table.filter(F.size("ids") == 0).count() == 0


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


CASES = {
    "Dr. Smith met Prof. Lee at 4 p.m. The talk began.": ["Dr. Smith met Prof. Lee at 4 p.m.", "The talk began."],
    "It rose from 3.14 to 2.5 overnight. See Fig. 3 and eq. 4 (cf. p. 7).": ["It rose from 3.14 to 2.5 overnight.", "See Fig. 3 and eq. 4 (cf. p. 7)."],
    '"Is it ready?" asked Ann. Yes!': ['"Is it ready?" asked Ann.', "Yes!"],
    'He said, "Stop. Go home!" and left.': ['He said, "Stop. Go home!" and left.'],
    "The notes (they were lost. sadly!) were found.": ["The notes (they were lost. sadly!) were found."],
    "Thanks! 😀 Next one.": ["Thanks! 😀", "Next one."],
    "Heading\n\nFirst sentence wrapped\nover lines. Second.": ["Heading", "First sentence wrapped\nover lines.", "Second."],
    "- one\n- two. Three\n- four": ["- one", "- two.", "Three", "- four"],
    "1. First item\n2. Second item. More": ["1. First item", "2. Second item.", "More"],
    "Tutor: Hello there. Sit down.\nStudent: Thanks": ["Tutor: Hello there.", "Sit down.", "Student: Thanks"],
    "Well... it works; really: yes - sure. Ok?": ["Well... it works; really: yes - sure.", "Ok?"],
    "the first ends. the second starts small.": ["the first ends.", "the second starts small."],
    "meet at 3 p.m. in the hall. it ends at 4 p.m. the rest is free.": ["meet at 3 p.m. in the hall.", "it ends at 4 p.m.", "the rest is free."],
    "It ended.Another began.": ["It ended.", "Another began."],
    "Run build.sh with v1.2.3 of www.site.example now.": ["Run build.sh with v1.2.3 of www.site.example now."],
    "“等一下。我们先看！”小组长说。太好了！": ["“等一下。我们先看！”小组长说。", "太好了！"],
    "「待って。早いよ！」と彼は言った。すごい！": ["「待って。早いよ！」と彼は言った。", "すごい！"],
    "यह ठीक है। क्या आप आए? डॉ. वेलान ने पूछा।": ["यह ठीक है।", "क्या आप आए?", "डॉ. वेलान ने पूछा।"],
    "ما هذا؟ الكتاب هنا. قال د. علي ذلك.": ["ما هذا؟", "الكتاب هنا.", "قال د. علي ذلك."],
    "วันนี้อากาศดี ครูอธิบายบทที่ 31 ให้ฟัง ขอบคุณค่ะ": ["วันนี้อากาศดี", "ครูอธิบายบทที่ 31 ให้ฟัง", "ขอบคุณค่ะ"],
    "В 17 г. вышло издание, т. е. вторая версия. А. Б. Ким писал.": ["В 17 г. вышло издание, т. е. вторая версия.", "А. Б. Ким писал."],
    "« C'est fini. On rentre ! » a dit Paul. Voir l'art. 51.": ["« C'est fini. On rentre ! » a dit Paul.", "Voir l'art. 51."],
    "Am 3. Oktober kommt z. B. Herr Dr. Kurz. Gut.": ["Am 3. Oktober kommt z. B. Herr Dr. Kurz.", "Gut."],
    "„Halt. Noch nicht!“, rief er. Warum?": ["„Halt. Noch nicht!“, rief er.", "Warum?"],
    "¿Qué es? ¡Nada! La Sra. Ruiz vio la pág. 4.": ["¿Qué es?", "¡Nada!", "La Sra. Ruiz vio la pág. 4."],
    # Words that are abbreviations in another language only, and there.
    "He told me. I left the room.": ["He told me.", "I left the room."],
    "Hier, le client a vu Me. Dupont. Il est sorti.": ["Hier, le client a vu Me. Dupont.", "Il est sorti."],
    "I met Max. He was tired.": ["I met Max.", "He was tired."],
    "She reached the max. Nobody else did.": ["She reached the max.", "Nobody else did."],
    "Die Anlage hat eine max. Leistung von 5 Watt. Das ist gut.": ["Die Anlage hat eine max. Leistung von 5 Watt.", "Das ist gut."],
    "The answer is no. 5 people left.": ["The answer is no.", "5 people left."],
    "The house in the street, no. 5, was sold. It was old.": ["The house in the street, no. 5, was sold.", "It was old."],
    "Give one to me. then we go.": ["Give one to me.", "then we go."],
    "She sat. 5 minutes later he came.": ["She sat.", "5 minutes later he came."],
    "She studied art. 5 years later she left.": ["She studied art.", "5 years later she left."],
    "Selon l'art. 5 de la loi, le client a tort. Il paie.": ["Selon l'art. 5 de la loi, le client a tort.", "Il paie."],
    "Das ist der Wagen von Fr. Weber. Ich komme mit. Danach gehen wir.": ["Das ist der Wagen von Fr. Weber.", "Ich komme mit.", "Danach gehen wir."],
    "Она читает книгу, см. рис. 3 и стр. 7. Потом спит.": ["Она читает книгу, см. рис. 3 и стр. 7.", "Потом спит."],
}


@pytest.mark.parametrize("text", CASES)
def test_rules(text):
    assert cut(text) == CASES[text]


def test_capitals_are_counted_over_the_whole_text():
    prose, numbers = "He came at 5 p.m. we left. " * 100, "123 456 789 12\n\n" * 300
    assert len(numbers) > 4000
    want = ["He came at 5 p.m. we left."] * 100
    assert cut(prose) == want and cut(numbers + prose)[-100:] == want


@pytest.mark.parametrize("text", [*(t for t in TEXTS), *CASES, "a.\r\n\r\nb", '"unclosed. quote. here', ")))", "." * 500, "(" * 3000, '"' * 3001, "x. " * 20_000, "-\n-\n- x"])
def test_sentences_cover_everything_once(text):
    spans = sentences(text)
    text = text or ""
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    held = set()
    for a, b in spans:
        assert not text[a].isspace() and not text[b - 1].isspace()
        held.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in held)
