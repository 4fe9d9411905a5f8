"""Problem 4: defective pairs of a prompt (source text) and its response (translation), with the defect of each.

One defect a pair, the first that holds:

* ``empty``: null or no words outside markers, though the source has some.
* ``refusal``: a sentence of the response, outside quotes, is in the refusal dictionary and none of the source's is; or, asked for
  in a language that the dictionary lacks, the response answers ``REPEATED`` or more sources of different prose and of quite
  different lengths.
* ``copy``: compressed with its prompt as a zstandard dictionary, the response's prose all but vanishes, as measured against
  the prompt compressed with itself, and an exact check of word sequences agrees.
* ``wrong_language``: by the language dictionaries (word frequencies of each language) another language than the one
  asked for is clearly likelier.
* ``truncated``: the response ends in an ellipsis that the source lacks, has fewer sentences, leaves a tag open, or has
  no closing punctuation where the source has some and the terminal-context model (how often a text ends after these last
  words) or a missing name, number or marker says that more should follow.

The language dictionaries are a classifier, fitted on at most ``FIT_ROWS`` labelled pairs and texts. All else is counted over
all pairs, in parts that are summed up: the words that translations carry over, of which those in a ``CARRIED_SHARE`` of all sources
go to the workers; terminal contexts and repeated answers, which stay tables and meet the answers that need them by join.

Names, numbers and markers are no prose: a text without prose may stay as it is. Defined results: a response whose prompt is
missing or null has no defect but a refusal in the dictionary; a source without words can't have an empty answer; ties
between languages go to the one asked for; repeats are judged one by one; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.skew import lookup_join
from quillstream.llm.common import checkpoint, sample_rows
from quillstream.llm.langid import language_code
from quillstream.llm.lookalike import canonical_text

FIT_ROWS = 8000
#: Log-likelihood by which another language must beat the one asked for.
LANGUAGE_MARGIN = 3.0
#: Part of a full copy's gain that the prompt as dictionary must bring, and share of the source's prose words that must come back in order.
COPY_GAIN, COPY_WORDS = 0.63, 0.8
#: A text whose last words end fewer texts than this share is taken to go on.
ENDS_HERE = 0.1
#: Sources of different prose with one and the same sentence for an answer, which has this many words, from which it is no
#: translation; and how many times as many words as the shortest the longest of them has.
REPEATED, REPEATED_WORDS, REPEATED_SPREAD = 5, 4, 2.0
#: Share of all pairs whose sources must have a word for it to go to the workers. So there are no more than words a pair / share.
CARRIED_SHARE = 1 / 2500
#: Pairs whose counts are summed before they leave a worker.
SUMMED_PAIRS = 20_000

_MARKER = re.compile(r"⟦[^⟧\s]{1,40}⟧|</?(?:em|strong|link)\d+>")
_TAG = re.compile(r"<(/?)(em|strong|link)(\d+)>")
_BROKEN_END = re.compile(r"(?:<[a-z/]{0,7}\d*|⟦[A-Za-z]*\d*)$")
_ELLIPSIS = re.compile(r"(?:\.\.\.+|…|\[\s*(?:\.\.\.|…)\s*\])[\s\"'”»」)]*$")
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+(?:[’'][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CLOSERS = "\"'”»」』）)]"
_ENDING = re.compile(rf"[.!?。！？][{re.escape(_CLOSERS)}]*\s*$")
_SENTENCE = re.compile(rf"(?<=[.!?])[{re.escape(_CLOSERS)}]*(?:\s+|$)|(?<=[。！？])[{re.escape(_CLOSERS)}]*\s*")
#: A remark in brackets at the end of a heading.
_ASIDE = re.compile(r"\s*\([^()]*\)\s*$")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|\"[^\"]+\"|[“„«「][^“”„»」]*$")

# How translators refuse or ask back, by language. Looked up in case-folded text of one form.
REFUSALS = {
    "en": [
        r"\bi(?:'m| am|’m)? (?:sorry|afraid)\b", r"\bi (?:can(?:no|')t|cannot|can’t|could not|couldn't|won't|will not|must decline|have to decline|need to decline|decline|refuse)\b", r"\bi(?:'m| am|’m) (?:not able|unable|not allowed|not permitted)\b", r"\bi(?:'d| would|’d) (?:rather|prefer) not\b",
        r"\bi (?:won't|will not|won’t) be able\b", r"\bas an? (?:ai|automated|language|virtual)\b[^.]*\b(?:assistant|model|system)\b", r"\b(?:outside|against|beyond)\b[^.]*\b(?:my|our) (?:guidelines|policy|policies|scope|rules)\b", r"\b(?:falls?|is|lies) outside (?:of )?what i\b",
        r"\b(?:request|task) (?:was |is |has been )?(?:refused|declined|denied)\b", r"\bno translation can be (?:offered|given|provided)\b", r"\b(?:please|could you|can you|would you)\b[^.]*\b(?:provide|share|send|paste|supply|give)\b[^.]*\b(?:text|context|passage|content|source)\b[^.]*\b(?:you|me|i|before|first|to)\b", r"\bmust decline\b", r"\b(?:could|can) you (?:please )?(?:clarify|specify|explain)\b", r"\bwhat would you like me to\b",
    ],
    "de": [
        r"\b(?:es tut mir leid|tut mir leid|leider (?:kann|darf|muss) ich|entschuldigung, (?:ich|aber))", r"\bich (?:kann|darf|muss|möchte|werde)\b[^.]*\b(?:nicht|ablehnen|verweigern|keine)\b", r"\bist mir nicht (?:möglich|gestattet|erlaubt)\b", r"\b(?:verstößt|verstoßen) gegen meine\b", r"\bbitte (?:senden|schicken|geben|nennen|übermitteln|teilen) sie mir\b", r"\bkönnten sie\b[^.]*\b(?:anfrage|präzisieren|genauer|erläutern|klären|kontext)\b", r"\bals (?:ki|automatisierter|virtueller|sprachmodell)\b", r"\baußerhalb dessen, was ich\b", r"\bkeine übersetzung (?:anbieten|liefern|möglich)\b",
    ],
    "fr": [
        r"\bje suis désolée?\b", r"\b(?:désolée?|pardon), (?:mais )?je\b", r"\bje ne (?:peux|suis|puis|pourrai|saurais)\b[^.]*\b(?:pas|puis)\b", r"\bje (?:dois|préfère|me vois)\b[^.]*\b(?:refuser|décliner|obligé|ne pas)\b", r"\bil m['’]est impossible\b", r"\bveuillez\b[^.]*\b(?:fournir|envoyer|transmettre|indiquer)\b[^.]*\b(?:texte|contexte|passage)\b", r"\bpourriez-vous\b[^.]*\b(?:préciser|demande|clarifier|texte|contexte)\b", r"\b(?:sort du cadre|dépasse le cadre)\b[^.]*\b(?:je|mes|que)\b", r"\ben tant qu['’](?:assistant|ia|intelligence)\b", r"\bcontraire à mes\b",
    ],
    "es": [
        r"\blo siento\b", r"\bdisculpe, (?:pero )?(?:debo|no)\b", r"\b(?:lamentablemente|desafortunadamente),? (?:no|debo)\b", r"\bno (?:puedo|estoy en condiciones|me es posible|podré|me está permitido)\b", r"\bdebo (?:rechazar|negarme|declinar)\b", r"\bqueda fuera de lo que puedo\b", r"\bfuera de mis\b", r"\bpor favor\b[^.]*\b(?:indíqueme|envíeme|proporcione|facilite|envíe|comparta)\b[^.]*\b(?:texto|contexto|pasaje)\b", r"\b(?:podría|puede) (?:aclarar|precisar|especificar|darme)\b", r"\bcomo (?:asistente|ia|modelo)\b", r"\bva contra mis\b",
    ],
    "pt": [
        r"\bsinto muito\b", r"\b(?:desculpe|lamento|infelizmente),? (?:mas )?(?:preciso|não|devo|tenho)\b", r"\bnão (?:posso|consigo|estou em condições|me é possível|poderei)\b", r"\bpreciso recusar\b|\btenho de recusar\b|\bdevo recusar\b", r"\bfora do que posso\b", r"\bpor favor\b[^.]*\b(?:envie|forneça|informe|indique|compartilhe)\b[^.]*\b(?:texto|contexto|trecho)\b", r"\bpoderia (?:esclarecer|precisar|especificar|explicar)\b", r"\bcomo (?:assistente|ia|modelo)\b[^.]*\bnão\b", r"\bcontra as minhas\b",
    ],
    "tr": [
        r"\b(?:üzgünüm|özür dilerim|maalesef)\b[^.]*(?:mıyorum|miyorum|muyorum|müyorum|amam|emem|zorundayım|edemem)\b", r"\b\w*(?:çeviremem|çeviremiyorum|sunamıyorum|sunamam|getiremiyorum|yapamıyorum|yapamam|reddetmek zorundayım|reddediyorum|olamıyorum)\b", r"\bele alabileceklerimin dışında\b|\byönergelerime\b|\bkurallarıma aykırı\b", r"\blütfen\b[^.]*\b(?:çevirmemi|metni|metin|bağlam)\b[^.]*\b(?:gönderin|iletin|paylaşın|verin|sağlayın)\b", r"\b(?:isteğinizi|talebinizi)\b[^.?]*\b(?:açar mısınız|açıklar mısınız|netleştirir misiniz|belirtir misiniz)", r"\bbir (?:yapay zeka|otomatik|dil modeli)\w*\b[^.]*\bolarak\b",
    ],
    "ru": [
        r"\b(?:извините|простите|к сожалению),? (?:но )?я\b", r"\bя (?:не могу|не в состоянии|не смогу|не имею права|вынужден\w*|должен\w* отказаться|отказываюсь|не вправе)\b", r"\bотказаться от этой\b|\bотклонить эту\b", r"\bза рамки того, что мне\b|\bпротиворечит моим\b|\bмоими правилами\b", r"\bпожалуйста\b[^.]*\b(?:пришлите|отправьте|предоставьте|укажите)\b[^.]*\b(?:текст|контекст)\b", r"\bне могли бы вы\b[^.?]*\b(?:уточнить|пояснить|запрос|контекст)\b", r"\bкак (?:искусственный|автоматический|языковая)\b",
    ],
    "ja": [
        r"(?:この|その)(?:文章|内容|文|テキスト|ご依頼|依頼|箇所|部分|作業|リクエスト)[^。]*(?:できません|できかねます|お断り|応えでき|範囲を超え|お受けでき)", r"翻訳を提供すること(?:が|は)できません|翻訳(?:は|を)?(?:提供|お出し)でき(?:ません|かねます)", r"(?:恐れ入りますが|申し訳(?:ございません|ありません)が|すみませんが)、?[^。]*(?:できません|できかねます|お断り|応えできません|ご遠慮)", r"翻訳してほしい(?:文章|文|テキスト|内容)[^。]*(?:お送り|送って|ご提示|教えて|ください)", r"ご依頼の内容を[^。]*(?:教えて|説明して)ください", r"(?:私|わたし)は(?:AI|自動)[^。]*(?:できません)", r"お断り(?:します|いたします)", r"対応できる範囲を超えて",
    ],
}
_PATTERNS = [canonical_text(p) for some in REFUSALS.values() for p in some]
_REFUSAL = re.compile("|".join(_PATTERNS))


def _literals(items) -> list[str] | None:
    """Texts of which any match of a parsed pattern holds one, as long as there can be; None if nothing is sure."""
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg)
            continue
        if run and (best is None or len(run) > min(map(len, best))):
            best = [run]
        run, found = "", None
        if str(op) == "SUBPATTERN":
            found = _literals(arg[3])
        elif str(op) == "BRANCH":
            parts = [_literals(x) for x in arg[1]]
            found = [x for p in parts for x in p] if all(parts) else None
        elif str(op) == "MAX_REPEAT" and arg[0] > 0:
            found = _literals(arg[2])
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found
    return best


def _automaton():
    """Finds in one pass whether a text holds what any refusal must hold; without such texts every text may refuse."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern in _PATTERNS:
        for literal in _literals(re._parser.parse(pattern)) or [""]:
            if not literal:
                return None
            found.add_word(literal, 1)
    found.make_automaton()
    return found


_MAY_REFUSE: list = []


def _fold(text: str) -> str:
    return text.replace("İ", "i").casefold()


def is_fragment(text: str) -> bool:
    """A heading or cell: nothing in it ends a sentence."""
    return len(_SENTENCE.split(_MARKER.sub("", text).strip())) == 1


def _words(text: str) -> list[str]:
    return _TOKEN.findall(text)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and _WORD.search(s)]


def refuses(text: str) -> bool:
    if not _MAY_REFUSE:
        _MAY_REFUSE.append(_automaton())
    text = _fold(text).replace("’", "'")
    if _MAY_REFUSE[0] is not None and next(_MAY_REFUSE[0].iter(text), None) is None:
        return False
    return any(_REFUSAL.search(s) for s in sentences(_QUOTED.sub(" ", text)))


def _grams(text: str) -> list[str]:
    """Dictionary entries of a text: words, and pairs of neighbours where a script has no spaces."""
    tokens = _TOKEN.findall(_fold(text))
    return [a if not _CJK.match(a) else a + b for a, b in zip(tokens, [*tokens[1:], ""]) if not a.isdigit()]


_WORD_MASK, _PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _joined(key: int, word: int) -> int:
    """A key with one more word's hash behind it."""
    key = ((key ^ word) * _PRIME) & _WORD_MASK
    return key ^ (key >> 29)


def _joined_all(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = (keys ^ words) * np.uint64(_PRIME)
    return keys ^ (keys >> np.uint64(29))


def _key(lang: str, tokens: list[str]) -> int:
    key = _hash(lang)
    for t in tokens:
        key = _joined(key, _hash(t))
    return _signed(key)


class PairModel:
    """Language dictionaries, and the words that translations carry over or change."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        """Fits the dictionaries on labelled texts (language, text)."""
        texts = [(lang, _grams(_MARKER.sub(" ", canonical_text(t)))) for lang, t in texts if t]
        self.languages = sorted({lang for lang, _ in texts})
        self.words: dict[str, tuple[float, ...]] = {}
        self.carried: set[str] = set()
        self.prose_words: set[str] = set()
        keep = texts
        for _ in range(2):
            self._dictionaries(keep)
            keep = [(lang, grams) for lang, grams in texts if self._likeliest(grams, lang)[0] == lang]

    def _dictionaries(self, texts: list[tuple[str, list[str]]]) -> None:
        counts: dict[str, Counter] = defaultdict(Counter)
        totals: Counter = Counter()
        for lang, grams in texts:
            for g in grams:
                counts[g][lang] += 1
            totals[lang] += len(grams)
        mean = sum(totals.values()) / max(1, len(totals))
        self.words = {g: tuple(math.log((c[n] * mean / max(totals[n], 1) + 0.5) / mean) for n in self.languages) for g, c in counts.items() if sum(c.values()) >= 3}

    def _likeliest(self, grams: list[str], asked: str) -> tuple[str, float]:
        """The likeliest language and how far it is ahead of the one asked for."""
        known = [self.words[g] for g in grams if g in self.words]
        if not known or asked not in self.languages:
            return asked, 0.0
        sums = [sum(x) for x in zip(*known, strict=True)]
        best, own = max(sums), sums[self.languages.index(asked)]
        return (asked, 0.0) if best == own else (self.languages[sums.index(best)], best - own)

    def prose(self, text: str) -> list[str]:
        """Words that a translation must change."""
        found = []
        for w in _words(_MARKER.sub(" ", text)):
            low = _fold(w)
            if low in self.prose_words or (low not in self.carried and w[0].islower() and len(w) > 1 and not any(c.isdigit() for c in w)) or (low in self.words and low not in self.carried and len(w) > 3) or _CJK.match(w):
                found.append(low)
        return found

    def _tokens(self, text: str) -> list[str]:
        """Last words before an end, names and numbers as classes."""
        found = []
        for t in _TOKEN.findall(_MARKER.sub(" X0 ", text)):
            low = _fold(t)
            if low == "x0":
                found.append("<marker>")
            elif t[0].isdigit():
                found.append("<number>")
            elif low not in self.words and not _CJK.match(t) and t[0].isupper():
                found.append("<name>")
            else:
                found.append(low)
        return found

    def parts(self, source: str, answer: str) -> tuple[bool, list[list[str]]]:
        """Whether the pair is a heading or cell; the tokens of the answer, or of each of its whole sentences. What an ellipsis ends isn't whole."""
        fragment = is_fragment(source)
        if _ELLIPSIS.search(answer):
            return fragment, []
        return fragment, [self._tokens(p) for p in ([_ASIDE.sub("", answer)] if fragment else [s for s in sentences(answer) if _ENDING.search(s)])]

    def ends_here(self, text: str, lang: str, fragment: bool, source: str) -> tuple[bool, list[int], bool]:
        """Whether the text surely breaks off; else the contexts, longest first, whose counts tell, and whether the last one is
        a word that whole sentences must have."""
        text = _ASIDE.sub("", text) if fragment else text
        tokens = self._tokens(text)
        if not tokens:
            return True, [], False
        last = _fold(_words(_MARKER.sub(" X0 ", text))[-1])
        known = last in self.words or last in self.carried or tokens[-1] in ("<marker>", "<number>") or bool(_CJK.match(last))
        if not known and last not in {_fold(w) for w in _words(source)}:
            return True, [], False
        # short headings and cells repeat: the context is the whole text so far; of sentences it is the last three words
        if fragment:
            return False, [_key(lang, tokens)], False
        word = not tokens[-1].startswith("<") and last not in self.carried
        return False, [_key(lang + "...", tokens[-n:]) for n in (3, 2, 1) if n <= len(tokens)], word


_plain: list = []


def compressed_away(prompt: bytes, response: bytes) -> float:
    """Share of the response's compressed size that the prompt as a dictionary saves."""
    import zstandard

    if not _plain:
        plain = zstandard.ZstdCompressor(level=1, write_content_size=False)
        _plain.extend((plain, len(plain.compress(b""))))
    plain, base = _plain
    known = zstandard.ZstdCompressor(level=1, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return 1 - (len(known.compress(response)) - base) / max(1, len(plain.compress(response)) - base)


def _in_order(wanted: list[str], there: list[str]) -> float:
    """Share of ``wanted`` that comes in ``there`` in the same order, greedily."""
    at, found = 0, 0
    places: dict[str, list[int]] = defaultdict(list)
    for n, w in enumerate(there):
        places[w].append(n)
    for w in wanted:
        own = places.get(w, ())
        k = bisect_left(own, at)
        if k < len(own):
            found, at = found + 1, own[k] + 1
    return found / max(1, len(wanted))


def copies(model: PairModel, source: str, answer: str, prose: list[str]) -> bool:
    if not prose:
        return False
    words = _words(_fold(_MARKER.sub(" ", answer)))
    if _in_order(prose, words) < COPY_WORDS:
        return False
    ours, theirs = " ".join(_words(_fold(_MARKER.sub(" ", source)))).encode(), " ".join(words).encode()
    # what stands around the copy is no part of the question: the prompt must explain the response or the response the prompt;
    # how much there is to gain depends on the length, and is what the prompt gains by itself
    return max(compressed_away(ours, theirs), compressed_away(theirs, ours)) >= COPY_GAIN * compressed_away(ours, ours)


def _open_tags(text: str) -> set[tuple[str, str]]:
    found = [m.groups() for m in _TAG.finditer(text)]
    return {(n, i) for e, n, i in found if not e} - {(n, i) for e, n, i in found if e}


def _kept(model: PairModel, text: str) -> Counter:
    """What any full translation repeats: numbers, names and markers."""
    bare = _MARKER.sub(" ", text)
    return Counter([*re.findall(r"\d+", bare), *(w for s in sentences(bare) for w in _words(s)[1:] if len(w) > 3 and w[0].isupper() and _fold(w) not in model.words), *re.findall(r"⟦[^⟧]*⟧", text)])


def truncated(model: PairModel, source: str, answer: str, lang: str, prose: list[str]) -> tuple[bool, list[int], int, bool]:
    """Whether the answer surely breaks off; else the contexts that may tell, how many texts must have them, whether the last must be known."""
    src, ans = source.rstrip(), answer.rstrip()
    if _ELLIPSIS.search(ans) and not _ELLIPSIS.search(src):
        return True, [], 0, False
    if _open_tags(ans) - _open_tags(src) or (ans.count("(") > ans.count(")") and src.count("(") <= src.count(")")) or (_BROKEN_END.search(ans) and not _BROKEN_END.search(src)):
        return True, [], 0, False
    if len(sentences(_MARKER.sub("", ans))) < len(sentences(_MARKER.sub("", src))):
        return True, [], 0, False
    fragment = is_fragment(src)
    if not fragment and _ENDING.search(_MARKER.sub("", ans)):
        return False, [], 0, False
    if ans.split()[-1] == src.split()[-1]:  # the same name, number or aside ends both
        return False, [], 0, False
    if _kept(model, src) - _kept(model, ans):
        return True, [], 0, False
    if not prose:
        return False, [], 0, False
    sure, keys, word = model.ends_here(ans, lang, fragment, src)
    return sure, keys, 1 if fragment else 3, word


@dataclass(frozen=True)
class Judgement:
    defect: str | None = None
    #: Contexts that tell whether the answer is truncated, longest first, and how many texts must have one.
    contexts: tuple[int, ...] = ()
    support: int = 0
    #: Whether the last context is a word that must be in a whole sentence somewhere.
    word: bool = False


def judge(model: PairModel, source: str | None, answer: str | None, asked: str | None) -> Judgement:
    """The pair's defect as far as it can be told without the tables."""
    answer, lang = canonical_text(answer or ""), language_code(asked) or ""
    if source is None:
        return Judgement("refusal" if refuses(answer) else None)
    source = canonical_text(source)
    if not _WORD.search(_MARKER.sub("", answer)):
        return Judgement("empty" if _WORD.search(_MARKER.sub("", source)) else None)
    prose = model.prose(source)
    if source.strip() == answer.strip() and not prose:
        return Judgement()
    if refuses(answer) and not refuses(source):
        return Judgement("refusal")
    if copies(model, source, answer, prose):
        return Judgement("copy")
    if prose and model._likeliest(_grams(_MARKER.sub(" ", answer)), lang)[1] >= LANGUAGE_MARGIN:
        return Judgement("wrong_language")
    sure, keys, support, word = truncated(model, source, answer, lang, prose)
    return Judgement("truncated" if sure else None, tuple(keys), support, word)


def sentence_key(answer: str, lang: str) -> int | None:
    """What an answer of some words that ends as a sentence is counted by, in languages without a dictionary."""
    bare = answer.strip()
    if lang in REFUSALS or not _ENDING.search(bare):
        return None
    words = _words(_fold(_MARKER.sub(" ", bare)))
    return _key(lang, words) if len(words) >= (2 * REPEATED_WORDS if _CJK.search(bare) else REPEATED_WORDS) else None


def pairs(prompts: DataFrame, key: str, text: str, version: str, responses: DataFrame, response_key: str, target: str, answer: str) -> DataFrame:
    """Each response with the latest version of its prompt: id, target, source, answer; one without a prompt has no source.

    A prompt with very many responses is no hot task.
    """
    latest = prompts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(version), F.col(text).alias("source"))).getField("source").alias("source"))
    asked = responses.select(F.col(key).alias("key"), F.col(response_key).cast("long").alias("id"), F.col(target).alias("target"), F.col(answer).alias("answer"))
    count = asked.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return lookup_join(asked, latest.join(count, "key"), ["key"], "n", how="left").select("id", "target", "source", "answer")


@dataclass
class Fitted:
    model: PairModel
    #: key, goes_on, ends: how often a text goes on and ends in a context.
    contexts: DataFrame
    #: key of each sentence that answers too many sources.
    repeated: DataFrame


def _evidence(model) -> object:
    """Counts of some pairs: kind (carried word, context, answer), key, other (an answer's source), word, a, b."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("other", pa.int64()), ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        heads: dict[tuple[int, bool], int] = defaultdict(int)
        answers: dict[tuple[int, int], int] = {}
        seeds: dict[str, int] = {}
        hashes: dict[str, int] = {}
        tokens: list[int] = []  # of whole sentences, one after another
        sizes: list[int] = []
        langs: list[int] = []
        pending = 0  # pairs since the last flush

        def hashed(text: str) -> int:
            n = hashes.get(text)
            if n is None:
                n = hashes[text] = _hash(text)
            return n

        def contexts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Key, times gone on and times ended of the contexts of up to three tokens in all sentences."""
            own = np.array(tokens, np.uint64)
            size = np.array(sizes, np.int64)
            ends = np.cumsum(size)
            seed = np.repeat(np.array(langs, np.uint64), size)
            place = np.arange(len(own)) - np.repeat(ends - size, size)
            last = np.zeros(len(own), bool)
            last[ends - 1] = True
            keys, ended = [], []
            for n in (1, 2, 3):
                at = np.flatnonzero(place >= n - 1)
                key = seed[at]
                for k in range(n - 1, -1, -1):
                    key = _joined_all(key, own[at - k])
                keys.append(key)
                ended.append(last[at])
            found, which = np.unique(np.concatenate(keys), return_inverse=True)
            end = np.bincount(which, np.concatenate(ended), minlength=len(found)).astype(np.int64)
            return found.view(np.int64), np.bincount(which, minlength=len(found)) - end, end

        def flush() -> Iterator[pa.RecordBatch]:
            counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for (key, ends), n in heads.items():
                counts[key][ends] += n
            rows = [("pairs", 0, 0, None, pending, 0)] + [("word", _signed(_hash(w)), 0, w, a, b) for w, (a, b) in words.items()] + [("context", _signed(k), 0, None, a, b) for k, (a, b) in counts.items()] + [("answer", k, o, None, n, 1) for (k, o), n in answers.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(schema.types)], schema=schema)
            if tokens:
                key, a, b = contexts()
                n = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(["context"] * n, pa.string()), pa.array(key), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.string()), pa.array(a), pa.array(b)], schema=schema)
            for x in (words, heads, answers, tokens, sizes, langs):
                x.clear()
            if len(hashes) > 200_000:
                hashes.clear()

        for batch in batches:
            for target, source, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang = language_code(target)
                if source is None or answer is None or lang is None:
                    continue
                source, answer = canonical_text(source), canonical_text(answer)
                ours = set(_words(_fold(_MARKER.sub(" ", source))))
                if source != answer:
                    there = set(_words(_fold(answer)))
                    for w in ours:
                        own = words[w]
                        own[0] += 1
                        own[1] += w in there
                fragment, parts = m.parts(source, answer)
                if lang not in seeds:
                    seeds[lang], seeds[lang + "..."] = _hash(lang), _hash(lang + "...")
                for part in parts:
                    if fragment:
                        key = seeds[lang]
                        for n, token in enumerate(part, 1):
                            key = _joined(key, hashed(token))
                            heads[key, n == len(part)] += 1
                    elif part:
                        tokens.extend(map(hashed, part))
                        sizes.append(len(part))
                        langs.append(seeds[lang + "..."])
                if (key := sentence_key(answer, lang)) is not None:
                    answers[key, _key("", sorted(ours))] = len(_words(_MARKER.sub(" ", source)))
                pending += 1
                if pending >= SUMMED_PAIRS:
                    yield from flush()
                    pending = 0
        yield from flush()

    return run


def fit(paired: DataFrame, labelled: DataFrame, bound: int = FIT_ROWS) -> Fitted:
    """The classifier on at most ``bound`` answers, labelled with the language asked for, and an eighth as many labelled texts (label,
    text); the counts over all of ``paired``, which is read twice."""
    spark = paired.sparkSession
    texts = [(language_code(r.label), r.text) for r in sample_rows(labelled.where("label is not null and text is not null"), "text", bound // 8, "label").toLocalIterator()]
    texts += [(language_code(r.target), r.answer) for r in sample_rows(paired.where("source is not null and answer is not null and target is not null").select("id", "target", "answer"), "id", bound, "target").toLocalIterator()]
    model = PairModel([t for t in texts if t[0]])
    counted = spark.sparkContext.broadcast(model)
    rows = paired.select("target", "source", "answer").mapInArrow(_evidence(counted), "kind string, key long, other long, word string, a long, b long")
    evidence = checkpoint(rows.groupBy("kind", "key", "other").agg(F.any_value("word").alias("word"), F.sum("a").alias("a"), F.sum("b").alias("b")))
    total = evidence.where("kind = 'pairs'").agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    for r in evidence.where((F.col("kind") == "word") & (F.col("a") >= max(3, total * CARRIED_SHARE))).select("word", "a", "b").toLocalIterator():
        (model.carried if r.b >= 0.5 * r.a else model.prose_words).add(r.word)
    contexts = evidence.where("kind = 'context'").select("key", F.col("a").alias("goes_on"), F.col("b").alias("ends"))
    size = F.col("a") / F.col("b")  # words of the source
    repeated = evidence.where("kind = 'answer'").groupBy("key").agg(F.count("*").alias("sources"), F.min(size).alias("least"), F.max(size).alias("most"))
    repeated = repeated.where((F.col("sources") >= REPEATED) & (F.col("most") >= REPEATED_SPREAD * F.col("least"))).select("key")
    return Fitted(model, contexts, repeated)


def defects(paired: DataFrame, fitted: Fitted) -> DataFrame:
    """id and defect of each defective pair."""
    shared = paired.sparkSession.sparkContext.broadcast(fitted.model)
    out = "id long, defect string, contexts array<long>, support int, is_word boolean, sentence long"
    schema = pa.schema([("id", pa.int64()), ("defect", pa.string()), ("contexts", pa.list_(pa.int64())), ("support", pa.int32()), ("is_word", pa.bool_()), ("sentence", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for i, t, s, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                j = judge(m, s, a, t)
                sentence = sentence_key(canonical_text(a), language_code(t) or "") if a and s is not None and j.defect not in ("empty", "refusal") else None
                if j.defect or j.contexts or sentence is not None:
                    rows.append((i, j.defect, list(j.contexts), j.support, j.word, sentence))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(schema.types)], schema=schema)

    judged = paired.select("id", "target", "source", "answer").mapInArrow(run, out)
    judged = checkpoint(judged.withColumn("row", F.monotonically_increasing_id()))
    asked = judged.where("sentence is not null").select("row", F.col("sentence").alias("key"))
    weight = asked.groupBy("key").agg(F.count("*").alias("n"))
    repeated = lookup_join(asked, fitted.repeated.join(weight, "key"), ["key"], "n").select("row", F.lit("refusal").alias("other"))
    # of an answer's contexts the longest with enough texts decides; where none has, nothing is known, unless no whole sentence has
    # the last word at all: then it is a part of one
    open_ = judged.where("defect is null and size(contexts) > 0").select("row", "support", "is_word", F.size("contexts").alias("of"), F.posexplode("contexts").alias("place", "key"))
    weight = open_.groupBy("key").agg(F.count("*").alias("n"))
    known = lookup_join(open_, fitted.contexts.join(weight, "key"), ["key"], "n", how="left").withColumn("texts", F.coalesce(F.col("goes_on") + F.col("ends"), F.lit(0)))
    enough = F.when((F.col("texts") >= F.col("support")) & (F.col("texts") > 0), F.struct("place", (F.col("ends") / F.col("texts")).alias("share")))
    unseen = F.max(F.col("is_word") & (F.col("place") == F.col("of") - 1) & (F.col("texts") == 0))
    ends = known.groupBy("row").agg(F.min(enough).getField("share").alias("share"), unseen.alias("unseen"))
    broken = ends.where((F.col("share") < ENDS_HERE) | (F.col("share").isNull() & F.col("unseen"))).select("row", F.lit("truncated").alias("other"))
    told = judged.where("defect is not null").select("row", F.col("defect").alias("other"))
    rank = F.when(F.col("other") == "refusal", 0).otherwise(1)
    best = told.unionByName(repeated).unionByName(broken).groupBy("row").agg(F.min_by("other", rank).alias("defect"))
    return judged.select("row", "id").join(best, "row").select("id", "defect")
