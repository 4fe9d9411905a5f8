"""Training-data operators against brute force, exact round trips and edge cases: nulls, empties, long texts, ties, repeats, empty tables."""

import hashlib
import json
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import dictcopies, langid, leaks, lookalike, packing, pairs, queries, splitting, tokens
from quillstream.llm.common import sample_rows

TEXTS = {
    "en": "The index page keeps the heading text. After every commit the editor removes the warning list and writes the report.",
    "de": "Die Startseite behält den Überschriftentext. Nach jedem Commit entfernt der Redakteur die Warnliste und schreibt den Bericht.",
    "fr": "La page d’accueil conserve le texte du titre. Après chaque validation la rédactrice supprime la liste et écrit le rapport.",
    "ja": "索引ページは見出しの文を保持します。変更のたびに、編集者は警告の一覧を削除します。",
}


@pytest.fixture(scope="module")
def model():
    return langid.fit([(lang, text) for lang, text in TEXTS.items()] * 3)


# --- 1 ---


@pytest.mark.parametrize(("label", "code"), [("en", "en"), (" EN ", "en"), ("pt-BR", "pt"), ("de_DE", "de"), ("und", None), ("?", None), ("", None), (None, None), ("english", None)])
def test_language_code(label, code):
    assert langid.language_code(label) == code


def test_blocks_and_fences():
    text = "# A\r\n\r\npara\r\n\r\n```\r\ncode\r\n\r\nmore\r\n```\r\n\r\nlast"
    assert [(n, b) for n, b in langid.blocks(text)] == [(1, "# A"), (2, "para"), (3, None), (4, None), (5, "last")]
    assert list(langid.blocks("")) == [] and list(langid.blocks("\n\n \n")) == []


def test_detect_edges(spark, model):
    mixed = TEXTS["de"] + " " + TEXTS["de"] + "\n\n" + TEXTS["fr"] + "\n\n```\n" + TEXTS["en"] * 5 + "\n```"
    data = [(1, TEXTS["en"], "de"), (2, mixed, "de"), (3, None, None), (4, "", None), (5, "123 --- !!!", None), (6, (TEXTS["ja"] + "\n\n") * 30000, "ja"), (1, TEXTS["en"], "en")]
    df = spark.createDataFrame(data, "id long, text string, lang string").withColumn("row_id", F.lit("clash"))
    got = defaultdict(list)
    for r in langid.detect(df, "id", "text", model, only_foreign=True, label="lang").collect():
        got[r.row_id].append((r.block_no, r.lang))
        assert 0 <= r.confidence <= 1
    assert sorted(got[1]) == [(0, "en"), (0, "en")] and sorted(got[2]) == [(0, "de"), (2, "fr")]
    assert got[3] == [(0, None)] and got[4] == [(0, None)] and got[5] == [(0, None)] and got[6] == [(0, "ja")]
    assert langid.detect(df.limit(0), "id", "text", model).count() == 0


def test_scores_are_dot_products_of_bundles():
    """What is worked out by ranges of dimensions, against whole vectors: bind, bundle, centre, cosine."""
    dims = 4 * langid._RANGE
    ids = np.unique(np.concatenate(langid.trigrams("abc def ґєї अआइ ")[1:]))[:12]
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 3, (3, len(ids))).astype(np.float32)

    def vector(symbol, roll):
        own = np.concatenate([langid.letter_vectors(np.array([symbol]), at, langid._RANGE)[0] for at in range(0, dims, langid._RANGE)])
        return np.roll(own.reshape(-1, langid._RANGE), roll, axis=1).ravel().astype(float)

    bound = np.array([vector(a, 2) * vector(b, 1) * vector(c, 0) for a, b, c in zip(*langid._symbols(ids))])
    bundles = weights @ bound
    bundles /= np.linalg.norm(bundles, axis=1, keepdims=True)
    bundles -= bundles.mean(axis=0)
    bundles /= np.linalg.norm(bundles, axis=1, keepdims=True)
    assert np.allclose(langid._dots(ids, weights, dims), bound @ bundles.T / np.sqrt(dims), atol=1e-4)


def test_every_letter_has_a_vector():
    letters = "αβγabcșệґابپहिंदीกขฃ漢字かな한글"
    symbols = {int(langid._LETTER[ord(c)]) for c in letters}
    assert len(symbols) == len(set(letters)) and 0 not in symbols
    vectors = langid.letter_vectors(np.array(sorted(symbols)), 0, 2048).astype(int)
    across = vectors @ vectors.T / 2048
    assert np.abs(across - np.eye(len(across))).max() < 0.12


def test_languages_of_one_script():
    """Languages that share a script without spaces between the alphabets: told apart by their letters."""
    texts = {
        "ar": "هذا النص مكتوب باللغة العربية ويتحدث عن إعدادات البرنامج وكيفية استخدامه في العمل اليومي", "fa": "این متن به زبان فارسی نوشته شده است و درباره تنظیمات برنامه و چگونگی استفاده از آن در کار روزانه گفتگو می‌کند",
        "hi": "यह पाठ हिन्दी भाषा में लिखा गया है और कार्यक्रम की सेटिंग के बारे में बताता है", "mr": "हा मजकूर मराठी भाषेत लिहिलेला आहे आणि कार्यक्रमाच्या सेटिंगबद्दल माहिती देतो",
        "ru": "Этот текст написан на русском языке и рассказывает о настройках программы", "uk": "Цей текст написаний українською мовою і розповідає про налаштування програми",
    }
    m = langid.fit([(lang, t) for lang, t in texts.items() for _ in range(4)])
    total, letters = m.score([t[len(t) // 3 :] for t in texts.values()])
    assert [m.languages[i] for i in total.argmax(axis=1)] == list(texts)


def test_lookup_finds_all():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 1 << 48, 300_000, dtype=np.uint64))
    found = langid.Lookup(known)
    assert (found(known) == np.arange(1, len(known) + 1)).all()
    other = rng.integers(1 << 48, 1 << 49, 50_000, dtype=np.uint64)
    assert (found(other) == 0).all() and (langid.Lookup(known[:0])(other) == 0).all()


def test_training_on_nothing():
    empty = langid.fit([])
    assert empty.languages == ["und"] and empty.score(["abc"])[1][0] == 3
    assert langid.calibrated(empty, []).certain == 0.999


def test_threshold_keeps_own_blocks(spark, data):
    """On texts neither trained nor calibrated on: few pieces count as foreign, and longer foreign ones do."""
    rows = [(langid.language_code(r.target_lang), r.translated_text) for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/translations.parquet").orderBy("translation_id").collect() if r.translated_text and langid.language_code(r.target_lang)]
    m = langid.calibrated(langid.fit(rows[::3]), rows[1::3])
    pieces = [p for p in langid.pieces_of(m, rows[2::3]) if p[0] >= 8]
    total, letters = m.score([t for _, _, t in pieces])
    at, lang = np.arange(len(pieces)), np.array([x for _, x, _ in pieces])
    scale = m.spread * np.sqrt(letters)
    own = total[at, lang]
    assert np.mean(langid._logistic((total.max(axis=1) - own) / scale) >= m.certain) < 0.01
    page = (lang + 1) % len(m.languages)
    assert np.mean((langid._logistic((own - total[at, page]) / scale) >= m.certain) & (total.argmax(axis=1) == lang)) > 0.9


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    m = langid.train(spark, [(docs, "doc_id", "lang", "text")], bound=60)
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if langid.language_code(r.lang)]
    found = {r.row_id: r.lang for r in langid.detect(docs, "doc_id", "text", m, only_foreign=True).where("block_no = 0").collect()}
    assert np.mean([found[r.doc_id] == langid.language_code(r.lang) for r in rows]) > 0.85  # some labels are wrong


# --- 2 ---


@pytest.mark.parametrize(("a", "b", "same"), [("Ａｂｃ", "Abc", True), ("é", "é", True), ("a​b­", "ab", True), ("a b　c", "a b c", True), ("Вор", "Bop", True), ("ﬁle", "file", True), ("x²", "x2", False), ("№ 5", "No 5", False), ("ı", "i", False), ("A", "a", False), ("a  b", "a b", False), ("⑤", "5", False), ("ё", "ë", True), ("е́", "é", True), ("Ο", "O", True), ("", "", True)])
def test_canonical(a, b, same):
    assert (lookalike.canonical_text(a) == lookalike.canonical_text(b)) is same


def test_sql_and_python_agree(spark):
    rng = random.Random(3)
    pool = [*"abcXYZ 123éİı№²™", *lookalike._SINGLE, *lookalike._LONGER, *lookalike._invisible()[:40], "́", "̈", "か", "ﾞ", "漢"]
    data = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(30)))) for i in range(400)] + [(400, None), (401, ""), (402, "ａ" * 200000)]
    df = spark.createDataFrame(data, "id int, text string").withColumn("out", F.lit(1)).withColumn("canonical", F.lit("clash"))
    got = {r.id: r.canonical for r in lookalike.canonicalise(df, "text").collect()}
    for i, t in data:
        assert got[i] == (None if t is None else lookalike.canonical_text(t)), (i, t)
    assert all(unicodedata.is_normalized("NFC", v) for v in got.values() if v)


# each spelling and the form that a reader sees, written down by hand
SEEN = {
    "Ⅳ": "IV", "ⅻ": "xii", "ĳ": "ij", "ǆ": "dž", "Ǉ": "LJ", "ŉ": "ʼn", "non‑breaking": "non-breaking", "a‐b": "a-b", "﹣": "-", "ＡＢＣ１２３！": "ABC123!", "ｶﾞｷﾞ": "ガギ", "ﾊﾟ": "パ", "￥": "¥", "ﬃ": "ffi", "ﻻ": "لا", "ﺏ": "ب",
    "a\u00a0b\u2009c\u3000d": "a b c d", "a\u200b\u2060b\ufeff": "ab", "e\u0301": "é", "A\u030a": "Å", "Ω": "Ω", "К": "K", "ѕсоре": "scope", "ΑΒΕ": "ABE", "Ё": "Ë", "Ά": "Á", "ﬅ": "st",
    "№": "№", "²": "²", "½": "½", "①": "①", "™": "™", "…": "…", "“a”": "“a”", "–": "–", "ı": "ı", "ß": "ß", "𝐀": "𝐀", "ㄱ": "ㄱ", "か゛": "か゛", "": "",
}


def test_forms_that_a_reader_sees(spark):
    df = spark.createDataFrame([(k, v) for k, v in SEEN.items()], "text string, seen string")
    assert {r.text: r.canonical for r in lookalike.canonicalise(df, "text").collect()} == SEEN
    assert {k: lookalike.canonical_text(k) for k in SEEN} == SEEN


def test_confusables_table():
    lines = ["\ufeff# confusables", "0430 ;\t0061 ;\tMA\t# ( а → a ) CYRILLIC", "03BA ; 0138 ; MA", "006D ; 0072 006E ; MA", "FF41 ; 0061 ; MA", ""]
    assert lookalike.read_confusables(lines) == {"а": "a", "ａ": "a"}


def test_hot_forms_are_paired_in_blocks(spark, monkeypatch):
    """A form with many spellings, and spellings with many rows, against a plain loop."""
    spaces = [" ", "\u00a0", "\u2009", "\u3000", "\u2003", "\u2002", "\u2004"]
    data = [(f"k{n:03}", f"one{spaces[n % 7]}text") for n in range(60)] + [(f"z{n}", "zero" + "\u200b" * (n % 2)) for n in range(9)] + [("only", "alone")]
    df = spark.createDataFrame(data, "k string, t string").withColumn("form", F.lit("clash")).withColumn("raw", F.lit(1))
    want = sorted((a, b) for a, x in data for b, y in data if a < b and x != y and lookalike.canonical_text(x) == lookalike.canonical_text(y))
    for block in (1000, 2):
        monkeypatch.setattr(lookalike, "BLOCK", block)
        assert sorted(map(tuple, lookalike.look_alike_pairs(df, "k", "t").collect())) == want
    groups, members = lookalike.forms(df, "k", "t")
    assert sorted((r.spellings, r.rows) for r in groups.collect()) == [(1, 1), (2, 9), (7, 60)] and members.count() == len(data)


def test_pairs_of_variants(spark):
    data = [("a", "Text"), ("b", "Теxt"), ("c", "Text"), ("d", "Τext"), ("a", "Text"), ("e", "other"), ("f", None), (None, "Text"), ("g", ""), ("h", "​")]
    got = {tuple(r) for r in lookalike.look_alike_pairs(spark.createDataFrame(data, "k string, t string"), "k", "t").collect()}
    assert got == {("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("g", "h")}
    assert lookalike.look_alike_pairs(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


# --- 3 ---


def test_copies_against_brute_force(spark):
    rng = random.Random(4)
    texts, names = ["Straße one", "STRASSE ONE!", "straße-one", "two", "two.", None, "", "..."], [("sourceText", "blockKind", "sourceFilePath"), ("source_text", "block_kind", "source_file_path"), ("SOURCETEXT", "BLOCKKIND", "SOURCEFILEPATH")]
    data = []
    for i in range(200):
        style = rng.choice(names)
        value = {style[0]: rng.choice(texts), style[1]: rng.choice(["Heading", "heading", None]), style[2]: rng.choice(["a/b.md", "A\\B.md", "c.md"]), "chunkId": str(i)}
        items = list(value.items())
        rng.shuffle(items)
        data.append((i, json.dumps(dict(items), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))))
    data += [(500, "no json"), (501, "No JSON!"), (502, None), (503, None), (504, "{}"), (505, "[1]")]
    fold = lambda x: None if x is None else re.sub(r"[\W_]", "", x.upper().lower())
    groups = defaultdict(list)
    for i, p in data[:200]:
        v = {re.sub("[^a-z]", "", k.lower()): x for k, x in json.loads(p).items()}
        groups[tuple(fold(v[k]) for k in ("sourcetext", "blockkind", "sourcefilepath"))].append(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)} | {(500, 501), (502, 503)}
    df = spark.createDataFrame(data, "id long, payload string").withColumn("key", F.lit(1)).withColumn("number", F.lit(2))
    for hot in (5, 10**6):
        counts, members = dictcopies.copies(df, "id", "payload", hot_rows=hot)
        assert {(r.first, r.key) for r in members.where("key > first").collect()} == want
        assert sum(r.copies for r in counts.collect()) == len(data)
    assert dictcopies.copies(df.limit(0), "id", "payload")[0].count() == 0


def test_marks_that_make_letters_count(spark):
    data = [(1, "किताब"), (2, "कताब"), (3, "किताब!"), (4, "กิน"), (5, "กน"), (6, "e\u0301t"), (7, "et"), (8, "ét"), (9, "ÉT.")]
    df = spark.createDataFrame([(i, json.dumps({"sourceText": t, "blockKind": None, "sourceFilePath": "a"})) for i, t in data], "id long, payload string")
    _, members = dictcopies.copies(df, "id", "payload")
    assert {(r.first, r.key) for r in members.where("key > first").collect()} == {(1, 3), (6, 7), (8, 9)}


# --- 4 ---


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with this.", "Leider kann ich das nicht übersetzen.", "Je ne peux pas traduire ce passage.", "No puedo traducir este texto.", "Não posso traduzir este texto.", "Bu metni çeviremem.", "Я не могу перевести этот текст.", "この文章は翻訳できません。", "Please send me the text you want translated first."])
def test_refusals(text):
    assert pairs.refuses(lookalike.canonical_text(text))


@pytest.mark.parametrize("text", ["Locked branches cannot be translated.", "If the screen shows “I cannot help with that”, start again.", "Sorry, this page has moved to another folder.", "ロックされたブランチは翻訳できません。", "Ask the team before changing this value."])
def test_no_refusals(text):
    assert not pairs.refuses(lookalike.canonical_text(text))


def _paired(spark, d):
    return pairs.pairs(spark.read.parquet(f"{d}/chunks.parquet"), "chunk_id", "source_text", "ingested_at", spark.read.parquet(f"{d}/translations.parquet"), "translation_id", "target_lang", "translated_text")


class Judge:
    """The whole rule in plain Python."""

    def __init__(self, fitted):
        self.model, self.contexts = fitted.model, {r.key: (r.goes_on, r.ends) for r in fitted.contexts.collect()}

    def defect(self, source, answer, asked):
        j = pairs.judge(self.model, source, answer, asked)
        for key in j.contexts:
            on, end = self.contexts.get(key, (0, 0))
            if on + end >= j.support:
                return "truncated" if end / (on + end) < pairs.ENDS_HERE else None
        return "truncated" if j.word and j.contexts[-1] not in self.contexts else j.defect


@pytest.fixture(scope="module")
def pair_model(spark, data):
    labelled = spark.read.parquet(f"{data}/documents.parquet").select(F.col("lang").alias("label"), "text")
    return Judge(pairs.fit(_paired(spark, data.replace("sf0.001", "sf0.01")), labelled))


SOURCE = "The runner keeps the old translation for Dovizu. The mirror marks the table cells in 12 steps."
GOOD = "Der Ausführer behält die alte Übersetzung für Dovizu. Der Spiegel markiert die Tabellenzellen in 12 Schritten."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (GOOD, None), (GOOD[:-1], None), (GOOD + "\n", None), (None, "empty"), ("", "empty"), ('""', "empty"), ("⟦CODE0⟧ <em0></em0>", "empty"), (SOURCE, "copy"), ("[de] " + SOURCE, "copy"), (SOURCE.replace("o", "о"), "copy"), (SOURCE.lower(), "copy"),
        (GOOD[:52], "truncated"), (GOOD[:80] + "...", "truncated"), ("Ich kann diesen Text leider nicht übersetzen.", "refusal"), ("L’exécuteur conserve l’ancienne traduction pour Dovizu. Le miroir marque les cellules du tableau en 12 étapes.", "wrong_language"),
    ],
)
def test_defects(pair_model, answer, want):
    assert pair_model.defect(SOURCE, answer, "de-DE") == want


def test_defect_edges(pair_model):
    assert pair_model.defect(None, "x", "de") is None
    assert pair_model.defect("OK", "OK", "de") is None and pair_model.defect("–", "–", "de") is None and pair_model.defect("–", None, "de") is None
    assert pair_model.defect("OK", "", "de") == "empty"
    assert pair_model.defect(SOURCE * 3000, GOOD * 3000, "de") is None
    assert pair_model.defect(SOURCE, GOOD, None) is None
    none = pairs.PairModel([])
    assert pairs.judge(none, "a b", "", "de").defect == "empty"
    words = " ".join(rng_word for rng_word in ["step", "again"] * 60_000).split()
    assert pairs._in_order(words, words[::-1]) > 0.9  # many repeats take no longer


def test_what_may_refuse_is_found_first():
    """The pass over literals drops no text that the patterns match."""
    for pattern in pairs._PATTERNS:
        assert all(pairs._literals(re._parser.parse(pattern)))
    rng = random.Random(1)
    texts = ["I'm sorry, but I can't help.", "Leider kann ich das nicht.", "No puedo traducir.", "この文章は翻訳できません。", "Bu metni çeviremem.", "As an AI language model", "Could you clarify?", "I would rather not."]
    for t in texts + ["".join(rng.sample(t, len(t))) for t in texts]:
        folded = lookalike.canonical_text(t)
        plain = any(pairs._REFUSAL.search(x) for x in pairs.sentences(pairs._QUOTED.sub(" ", pairs._fold(folded).replace("’", "'"))))
        assert pairs.refuses(folded) is plain


def test_defects_of_tables(spark, data):
    """Joins and tables against the rule in plain Python; a refusal in a language without a dictionary; answers without prompts."""
    labelled = spark.read.parquet(f"{data}/documents.parquet").select(F.col("lang").alias("label"), "text")
    nouns = ["table", "mirror", "branch", "folder", "runner", "report"]
    prompts = spark.createDataFrame([(f"n{i}", f"The {w} keeps the old list" + f" of {w} names" * i + ".") for i, w in enumerate(nouns)] + [(f"m{i}", f"Ask the {w} first") for i, w in enumerate(nouns)], "k string, t string").withColumn("v", F.lit(1))
    same = [(f"m{i}", 9200 + i, "nl", "Vraag het eerst aan het team.") for i in range(6)] + [(f"n{i}", 9300 + i, "de", "Fragen Sie zuerst das ganze Team.") for i in range(6)]
    answers = spark.createDataFrame(same + [(f"n{i}", 9000 + i, "nl", "Ik mag deze tekst helaas niet vertalen.") for i in range(6)] + [("gone", 9100, "de", "Ich kann diesen Text leider nicht übersetzen."), ("gone", 9101, "de", ""), ("gone", 9102, "de", "x")], "k string, id long, lang string, a string")
    both = _paired(spark, data).unionByName(pairs.pairs(prompts, "k", "t", "v", answers, "id", "lang", "a")).withColumn("row", F.lit("clash"))
    fitted = pairs.fit(both, labelled)
    got = Counter(map(tuple, pairs.defects(both, fitted).collect()))
    judge = Judge(fitted)
    want = Counter((r.id, d) for r in both.collect() if (d := "refusal" if r.id in range(9000, 9006) else judge.defect(r.source, r.answer, r.target)))
    assert got == want and got[9100, "refusal"] == 1 and sum(got.values()) > 20 and (9101, "empty") not in got
    empty = both.limit(0)
    assert pairs.defects(empty, pairs.fit(empty, labelled.limit(0))).count() == 0


def test_samples_are_the_same_and_keep_rare_labels(spark):
    df = spark.createDataFrame([(i, "en-US" if i % 50 else "fi") for i in range(5000)], "id long, lang string").repartition(7)
    one = sorted(tuple(r) for r in sample_rows(df, "id", 300, "lang").collect())
    assert one == sorted(tuple(r) for r in sample_rows(df.repartition(3), "id", 300, "lang").collect())
    assert Counter(x for _, x in one) == {"en-US": 200, "fi": 100}
    assert sample_rows(df, "id", 300).count() == 300 and sample_rows(df, "id", 9000).count() == 5000 and sample_rows(df.limit(0), "id", 9, "lang").count() == 0


def test_copy_gain():
    text = SOURCE.encode()
    assert pairs.compressed_away(text, text) > 0.8 > pairs.compressed_away(text, GOOD.encode())
    for source in ("Hold on", "The list", SOURCE):  # of any length
        copy, other = (pairs.copies(pairs.PairModel([]), source, a, source.casefold().split()) for a in (source + "!", GOOD))
        assert copy and not other


def test_pairs_take_the_latest_prompt(spark):
    prompts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1), (None, "x", 1)], "k string, t string, v int")
    answers = spark.createDataFrame([("a", 1, "de", "x"), ("a", 2, "de", None), ("b", 3, "de", "y"), ("zz", 4, "de", "y"), (None, 5, "de", "y")], "k string, id long, lang string, a string")
    assert {(r.id, r.source) for r in pairs.pairs(prompts, "k", "t", "v", answers, "id", "lang", "a").collect()} == {(1, "new"), (2, "new"), (3, None), (4, None), (5, None)}


# --- 5 ---


def test_counts_are_the_encodings(data):
    c = tokens.counter()
    rng = random.Random(1)
    for t in [*(r[0] for r in duckdb.sql(f"select text from '{data}/documents.parquet'").fetchall()), "", " ", "\n\n\n x", "a \n\n\tb\r\n\r\n c", "\x1c\n\x1c", *("".join(rng.choice("a \n\t.\r。é") for _ in range(200)) for _ in range(200))]:
        assert c.count(t) == len(c.encoding.encode_ordinary(t))


def test_assignment_is_the_plain_rule():
    rng = random.Random(2)
    for capacity in (10, 64):
        items = sorted((rng.randrange(1, capacity) for _ in range(200)), reverse=True)
        spent, room, want = [], [], []
        for _ in range(-(-sum(items) // capacity)):
            spent.append(0.0), room.append(capacity)
        for n in items:
            fit = [(spent[k], k) for k in range(len(room)) if room[k] >= n]
            if not fit:
                spent.append(0.0), room.append(capacity)
                fit = [(0.0, len(room) - 1)]
            k = min(fit)[1]
            spent[k] += packing.cost(n)
            room[k] -= n
            want.append(k)
        assert packing.assign(items, capacity) == want


def test_pack(spark):
    data = [(i, "word " * (i % 90)) for i in range(300)] + [(1000, "long " * 700), (1001, None), (1002, ""), (5, "again")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = packing.pack(df, "doc_id", "text", capacity=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.container_id] += r.tokens
    assert max(sizes.values()) <= 100
    assert Counter(r.doc_id for r in got if r.piece_no == 0) == Counter(i for i, t in data if t is not None)
    c = tokens.counter()
    for i, t in data:
        if t is not None and i != 5:
            assert sum(r.tokens for r in got if r.doc_id == i) == c.count(t)
    assert np.mean(list(sizes.values())) > 93
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# --- 6 ---


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60])))) for i in range(30)] + [(98, None), (99, ""), (97, "x " * 300), (None, "y " * 30)]
    docs = []
    for i in range(150):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        source = rng.choice(items[:30])[1].split()
        at = rng.randrange(len(source))
        cut = source[at : at + rng.randrange(8, 40)]
        style = rng.choice([" ", "\n> ", " **", ", "])
        docs.append((i, " ".join(body) + "\n\n" + style.join(w.upper() if rng.random() < 0.2 else w for w in cut) + "\n\n" + " ".join(body[:5])))
    docs += [(200, None), (201, ""), (202, items[3][1] * 2), (202, items[3][1] * 2), (203, "x " * 400000 + max((t for _, t in items[:30]), key=len))]
    index = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 11):
            if i is not None:
                index[tuple(w[k : k + 12])].add(i)
    want = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in index.get(tuple(w[k : k + 12]), ())}
    corpus = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("id", F.lit("clash"))
    held = spark.createDataFrame(items, "item_id long, text string")
    for most, listed in ((16_000_000, 1000), (0, 1000), (0, 1)):  # the items in one index, and by shuffle
        monkeypatch.setattr(leaks, "BLOCK_CHARS", most)
        monkeypatch.setattr(leaks, "ITEMS_OF_KEY", listed)
        found = leaks.leaks(corpus, "doc_id", "text", held, "item_id", "text")
        assert sorted((r.doc_id, r.item_id) for r in found.where("edits = 0").collect()) == sorted(want) and len(want) > 30
        assert found.where("item_id = 97").first().words == 300
        assert leaks.leaks(corpus.limit(0), "doc_id", "text", held, "item_id", "text").count() == 0
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 16_000_000)
    assert leaks.leaks(corpus, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


def recall_of(kind, length, vocabulary=3000, passages=600, seed=12):
    """Found of passages with one edit each, every place in turn, among those that exact edit distance confirms; and false ones."""
    rng = random.Random(seed)
    items, texts = [], []
    for i in range(passages):
        w = [f"t{rng.randrange(vocabulary)}" for _ in range(length)]
        p = i % length
        edited = w[:p] + {"changed": ["new"], "added": ["new", w[p]], "lost": []}[kind] + w[p + 1 :]
        around = [[f"t{rng.randrange(vocabulary)}" for _ in range(rng.randrange(15))] for _ in range(2)]
        items.append((i, " ".join(w)))
        texts.append(" ".join(around[0] + edited + around[1]))
    found = leaks.scan(leaks.ItemIndex(items, leaks.tables_for(leaks.RECALL, 12, 1)), texts, max_edits=1)
    true = lambda n, i: any(leaks.edits_within(items[i][1].split()[q : q + 12], texts[n].split(), 1) for q in range(length - 11))
    return sum((n, n) in found for n in range(passages)) / passages, [x for x in found if not true(*x)]


@pytest.mark.parametrize("kind", ["changed", "added", "lost"])
@pytest.mark.parametrize("length", [12, 13, 16, 20, 30, 40, 80])
def test_recall_by_edit_and_length(kind, length):
    share, false = recall_of(kind, length, passages=300)
    assert share >= 0.9 and not false


def test_common_words_against_edit_distance():
    """Of few words, where nearly everything is like everything: all that is found is true, and 0.9 of what is true is found."""
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(9)}" for _ in range(12))) for i in range(60)]
    texts = [" ".join(f"t{rng.randrange(9)}" for _ in range(400)) for _ in range(40)] + [t.replace("t1", "new", 1) for _, t in items]
    want = {(n, i) for n, t in enumerate(texts) for i, item in items if leaks.edits_within(item.split(), t.split(), 1)}
    found = set(leaks.scan(leaks.ItemIndex(items, leaks.tables_for(leaks.RECALL, 12, 1)), texts, max_edits=1))
    assert found <= want and len(found) >= 0.9 * len(want) >= 54


def test_longest_passage_and_fewest_edits():
    item = " ".join(f"a{n}" for n in range(40))
    index = leaks.ItemIndex([(1, item)], 7)
    w = item.split()
    assert leaks.scan(index, ["x " + " ".join(w[3:33]) + " y"], max_edits=1) == {(0, 0): (0, 30)}
    assert leaks.scan(index, [" ".join([*w[:11], "new", *w[12:20]])], max_edits=1) == {(0, 0): (1, 20)}
    assert leaks.scan(index, [" ".join(w[:11])], max_edits=0) == {} == leaks.scan(index, [" ".join([*w[:6], "x", "y", "z", *w[9:14]])], max_edits=1)


def test_scripts_without_spaces():
    index = leaks.ItemIndex([(1, "索引ページは見出しの文を保持します。変更のたびに警告を削除します。"), (2, "สวัสดีชาวโลกทุกคนในวันนี้")], 7)
    found = leaks.scan(index, ["前置き。索引ページは見出しの文を保持します。あと。", "x สวัสดีชาวโลกทุกคน y", "索引の見出し"])
    assert set(found) == {(0, 0), (1, 1)}
    assert leaks.Words(["Ünïcode ÉTÉ e\u0301te\u0301"]).hash[1] == leaks.Words(["été"]).hash[0]


def test_two_edits_against_edit_distance():
    rng = random.Random(13)
    items = [(i, " ".join(f"t{rng.randrange(40)}" for _ in range(14))) for i in range(60)]
    texts = []
    for _, t in items:
        w = ["a", "b"] + t.split() + ["c"]
        w[rng.randrange(2, 16)] = "changed"
        del w[rng.randrange(2, 16)]
        texts.append(" ".join(w))
    want = {(n, i) for n, t in enumerate(texts) for i, item in items if any(leaks.edits_within(item.split()[q : q + 12], t.split(), 2) for q in range(3))}
    found = set(leaks.scan(leaks.ItemIndex(items, leaks.tables_for(leaks.RECALL, 12, 2)), texts, max_edits=2))
    assert found <= want and len(found) >= 0.9 * len(want) >= 50


def test_numbered_lists_and_wrapped_numbers():
    item = "the batch of nine chunks closes after item forty two and then the team at the gate renames it"
    index = leaks.ItemIndex([(1, item)], 2)
    parts = item.split()
    listed = "1. " + " ".join(parts[:9]) + "\n1. " + " ".join(parts[9:])
    assert (0, 0) in leaks.scan(index, [listed])
    numbered = leaks.ItemIndex([(1, "closes its batch after chunk 915. When seven answers arrive the ids go on to the gate")], 2)
    assert (0, 0) in leaks.scan(numbered, ["closes its batch after chunk\n915. When seven answers arrive the ids go on to the gate"])


# --- 7 ---


@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (64, 16), (16, 4), (8, 0)])
def test_split_invariants(data, limit, overlap):
    own = splitting.Splitter(limit, overlap)
    texts = [r[0] for r in duckdb.sql(f"select text from '{data}/documents.parquet' limit 40").fetchall()]
    texts += ["", "a", "x" * 5000, "日本語" * 500, "😀" * 300, " " * 500, "\n" * 400, "a b " * 800, "```\n" + "code line\n\n" * 200 + "```\n\nend"]
    for text in texts:
        found = own.split(text)
        assert "".join(text[b:c] for _, b, c, _ in found) == text
        for n, (a, b, c, size) in enumerate(found):
            assert len(own.counter.encoding.encode_ordinary(text[a:c])) == size <= limit
            assert (a <= b < c or not text) and (not n or found[n - 1][0] <= a and found[n - 1][2] == b)


def test_split_prefers_blocks():
    text = "\n\n".join(f"Paragraph {i} has some words in it, and a second part." for i in range(60))
    own = splitting.Splitter(100, 20)
    assert all(text[b : b + 2] == "\n\n" for _, b, _, _ in own.split(text)[1:])
    code = "Intro.\n\n```\n" + "line one\n\nline two\n" * 20 + "```\n\nEnd."
    assert all(text_after.startswith("\n") for _, b, _, _ in own.split(code)[1:] for text_after in [code[b:]])


def test_pieces_do_not_depend_on_the_ranges(data):
    """Whole pages as one range, against ranges that cut lines, fences, line breaks and characters; anchors at every few pieces."""
    rng = random.Random(7)
    texts = [r[0] for r in duckdb.sql(f"select text from '{data}/documents.parquet'").fetchall()]
    texts += ["", "a", "x" * 5000, "日本語" * 500, "a b " * 3000, "```\n" + "code line\n\n" * 900 + "```\n\nend", "語" * 9000 + "\r\n\r\n" + "ab " * 3000, *("".join(rng.choice("a \n\t.\r。é`'1") for _ in range(3000)) for _ in range(20))]
    for limit, overlap, stretch in ((512, 64, 1 << 19), (64, 16, 1500), (128, 32, 1000)):
        own = splitting.Splitter(limit, overlap, stretch=stretch)
        for text in texts:
            want = own.split(text, 1 << 26, 2048)
            assert own.split(text, 4096, 2048) == own.split(text, 1 << 16, 2048) == want
            assert "".join(text[b:c] for _, b, c, _ in want) == text


def _as_tuples(found):
    return sorted((r.doc_id, r.piece_no, r.start, r.new_from, r.stop, r.tokens, r.text) for r in found)


def test_giant_texts_are_cut_as_small_ones(spark, data, tmp_path):
    """Texts whose ranges lie in many tasks, from a column and from files, against the same texts in one task."""
    df = spark.read.parquet(f"{data}/documents.parquet").where("n_chars > 3000").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "語" * 500 + "\r\n\r\n" + "ab " * 3000), (10**6 + 3, "```\n" + "code line\n\n" * 900 + "```\n\nend")], "doc_id long, text string"))
    args = {"limit": 128, "overlap": 32, "halo": 2048, "stretch": 1000}
    want = _as_tuples(splitting.split(df, "doc_id", "text", **args).collect())
    assert _as_tuples(splitting.split(df.withColumn("key", F.lit("clash")), "doc_id", "text", range_bytes=4096, whole_bytes=3000, **args).collect()) == want
    assert {w[0] for w in want} == {r.doc_id for r in df.where("text is not null").collect()}
    files = []
    for r in df.where("length(text) > 3000").collect():
        (tmp_path / f"{r.doc_id}.md").write_bytes(r.text.encode())
        files.append((r.doc_id, str(tmp_path / f"{r.doc_id}.md"), len(r.text.encode())))
    assert _as_tuples(splitting.split_files(spark, files, range_bytes=4096, **args).collect()) == [w for w in want if w[0] in {f[0] for f in files}]
    assert splitting.split(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id for r in splitting.split(spark.createDataFrame([(None, "x" * 9000)], "doc_id long, text string"), "doc_id", "text", whole_bytes=3000).collect()} == {None}


def test_files_of_pages(spark, data, tmp_path):
    """All pages as large files, split and put together again."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**9, None)], "doc_id long, text string"))
    listed = splitting.files_of(docs, "doc_id", "text", f"file://{tmp_path}/files", 100_000)
    pieces = splitting.split_files(spark, listed, range_bytes=20_000, halo=4096, stretch=9000).orderBy("doc_id", "piece_no").collect()
    want = "".join(r.text + "\n\n" for r in docs.where("text is not null").orderBy("doc_id").collect())
    assert len(listed) > 1 and "".join(r.text[r.new_from - r.start :] for r in pieces) == want
    assert splitting.files_of(docs.limit(0), "doc_id", "text", f"{tmp_path}/none") == []


def test_a_file_of_100_mb(spark, tmp_path):
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "日本"]) for _ in range(rng.randrange(3, 14))) + rng.choice([".", ".", ";"]) + rng.choice(["\n", "\n\n", "\r\n\r\n"]) for _ in range(3000)]
    block = "".join(lines) + "```\n" + "code\n\n" * 50 + "```\n\n"
    text = block * (100_000_000 // len(block.encode()) + 1)
    (tmp_path / "big.md").write_bytes(text.encode())
    pieces = splitting.split_files(spark, [(1, str(tmp_path / "big.md"), len(text.encode()))], range_bytes=1 << 22)
    own = pieces.select("piece_no", "start", "new_from", "stop", "tokens", F.sha2("text", 256).alias("h")).toPandas().sort_values("piece_no")
    assert own["piece_no"].tolist() == list(range(len(own))) and own["tokens"].max() <= 512
    assert own["new_from"].iloc[0] == 0 and own["stop"].iloc[-1] == len(text) and own["new_from"].tolist()[1:] == own["stop"].tolist()[:-1]
    for r in own.iloc[:: len(own) // 50].itertuples():
        assert hashlib.sha256(text[r.start : r.stop].encode()).hexdigest() == r.h and (r.piece_no == 0 or r.new_from - r.start > 40)


# --- queries ---


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for file in os.listdir(data):
            con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
        want = con.sql(sql)
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
