"""Broken question-answer pairs: empty, truncated, refusing, copied and other-language answers.

Refusals are found by their templates.  The opening of each answer is masked (words of its own question, numbers),
equal openings are counted once, and the distinct ones are clustered by MinHash over five-word shingles, each
candidate verified at a similarity of ``SIMILARITY``.  A cluster that recurs across unrelated prompts and whose
answers decline is a refusal template; its members are refusals also where they don't say so themselves, and an
answer that merely sounds like one inside a sound template is none.  The phrases by which answers decline are only
seeds: from the templates that have them the words of refusals are learned, and a cluster that is given evenly to
unrelated prompts and is worded like the others is a refusal template without any of the phrases.  Copies, languages
and the termination of an answer are checked on the pair; whether an answer without a full stop is complete is judged
by how often its last words end sentences in the whole collection.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.cluster import components, shingles, similar_links
from memloom.workspace import discard, in_arrow, materialize, spread

#: Words of an opening.  Openings of 49 words or more stay together when one word inside them changes: (n - 9) of
#: (n + 1) shingles of five words are shared.
OPENING_WORDS = 64
#: A template recurs across unrelated prompts from so many distinct question templates on.
UNRELATED_PROMPTS = 3
#: Share of a template's answers that must decline in words.
DECLINING_SHARE = 0.5
#: Log odds, in all and for each word, from which on the words of a template without such phrases are those of refusals.
REFUSING_WORDS, REFUSING_WORD = 2.5, 0.8
#: Answers of up to so many words keep all their frequent words in openings.
SHORT_WORDS = 8
#: Share of a template's answers that may say something new (a name, a number, an unusual word) if it is to be one of refusals
#: by its words.
NEW_SHARE = 0.1
#: Most frequent words that keep their form in n-grams; all others are masked.
FREQUENT_WORDS = 1500
#: Those that keep their form in openings, so that equal templates fall together before they are clustered.
OPENING_FREQUENT = 400
#: An ending is unusual if its words were seen inside sentences at least so often, and ended one in less than this share.
ENDING_SEEN, ENDING_SHARE = 5, 0.005
#: A word after which a sentence never went on so is a cut one if so many longer words after the same one begin with it.
CUT_WORD_SEEN = 10

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\u2028\u2029]")

# Markers of a missing value.
MISSING = frozenset("null none nan n/a na nil undefined missing <null> (none) (null) [] {} <na> <none> [null] [none] #n/a none. null. n.a. n.a not available() -".split())

# Ways to decline, at the beginning of an answer after an optional lead.
_LEAD = r"(?:(?:i'?m |i am )?(?:so |very )?sorry(?:,? but| about that)?|unfortunately|i apologi[sz]e(?:,? but)?|my apologies|hmm+|hm|well|oh|as an ai(?: language)?(?: model| assistant)?|désolée?|malheureusement|je suis désolée?(?: mais)?|tut mir leid|es tut mir leid|leider|entschuldigung|lo siento(?: pero)?|lamentablemente|perdón|regrettably|based on the (?:given )?context|from the (?:given )?context)\W+"
_DECLINES = re.compile(
    rf"^\W*(?:{_LEAD})*(?:"
    r"(?:i|we)(?:'m| am|'re| are)? (?:do not|don't|cannot|can ?not|can't|couldn't|could not|not able|unable|not sure|not aware|not certain|must decline|have to decline|decline|won't|will not|would rather not|wasn't able|have no|have not|haven't|lack|didn't find)\b"
    r"|(?:this|that|the|these|those|it|there|the provided|the given|provided|given|my|your|our)\b[^.!?]{0,45}?\b(?:is not|isn't|was not|wasn't|are not|was never|were never|does not|doesn't|do not|don't|did not|didn't|cannot|can't|is no|was no|are no|is silent|are silent|is unknown|are unknown|is unclear|not available)\b[^.!?]{0,60}?(?:mention|specif|stat|say|said|given|know|answer|determin|provid|avail|contain|includ|clear|inform|silent|this|discuss|found|record|tell|cover|reveal|unclear|unknown|on this|$)"
    r"|(?:this|the|these|those|provided|given|my)\b[^.!?]{0,40}?\b(?:is|are) silent\b"
    r"|it'?s? (?:is )?(?:not|impossible|unclear|unknown|never)\b[^.!?]{0,30}?(?:mention|specif|stat|said|given|know|clear|tell|say|determin|impossible|unclear|unknown|possible|$)"
    r"|nothing (?:in|is|was)\b[^.!?]{0,40}?(?:answer|mention|say|said|context|known|given)"
    r"|no (?:idea|clue|answer|information|info|mention|evidence|relevant|details?|such|data|record)\b(?!.{0,60}\bso\b)"
    r"|not (?:mentioned|specified|stated|given|provided|known|available|enough|sure|answerable|clear|in the|discussed|recorded)\b|never (?:mentioned|stated|said)\b"
    r"|(?:unknown|unanswerable|unclear|unspecified|undisclosed|insufficient (?:information|context|evidence)|cannot (?:be )?(?:answer|determin|tell|say)\w*|can't (?:say|tell|answer|help)\w*|don't know|do not know|dunno|idk|beats me|who knows|impossible to (?:say|tell|know)|answer unknown|information not)\b"
    r"|(?:das |es )?(?:weiß ich|ich weiß)\b.{0,15}\bnicht|dazu (?:liegen|gibt es|habe ich|steht|kann ich)\b|darüber (?:liegen|gibt|habe|weiß|steht)\b|das (?:geht|steht|wird|wurde|lässt|ist|kann ich)\b.{0,50}\b(?:nicht|unbekannt|unklar|nirgends)|im (?:kontext|gespräch|text) (?:steht|wird|gibt)\b.{0,40}\b(?:nichts|nicht|keine)|der kontext (?:gibt|sagt|enthält|erwähnt)\b.{0,40}(?:nicht|keine)|(?:diese|die|auf diese) frage\b.{0,30}\bnicht|keine (?:ahnung|angaben?|informationen?|antwort)|nicht (?:bekannt|angegeben|erwähnt|genannt)|unbekannt|ich kann\b.{0,40}\bnicht|ich habe (?:dazu |darüber )?keine"
    r"|je (?:ne |n'|l')\S*.{0,25}\b(?:pas|aucune?|ignore|rien)\b|je l'ignore|cela n'est|ce n'est pas (?:mentionné|précisé|indiqué|dit)|c'est inconnu|le contexte (?:ne|n')|la conversation (?:ne|n')|rien (?:dans|n')|aucune? (?:idée|information|réponse|mention)|(?:pas|non) (?:mentionné|précisé|spécifié|indiqué|disponible)|inconnu|on ne sait pas|il n'y a (?:pas|aucune)|impossible (?:de|à)\b"
    r"|no (?:lo |la )?(?:sé|sabemos|puedo|dispongo|tengo|hay|se (?:menciona|sabe|indica|especifica|dice)|consta|aparece|está)\b|ni idea|(?:eso|esto) no (?:se|aparece|está|consta)|el contexto no|la conversación no|desconocid[oa]|sin (?:información|respuesta|datos)|ninguna? (?:información|idea)|no (?:mencionado|especificado|disponible)"
    r")",
    re.I,
)
_ANYWHERE = re.compile(r"as an ai (?:language )?(?:model|assistant)|can't help with that|not able to share personal|cannot share (?:personal|private)|must decline to answer|couldn't find anything on|can't access private|there is no information about (?:that|this) in the", re.I)

_FUNCTION = {
    "en": "the a an and or but of to in on at for with from by is are was were be been has have had do does did not that this these those it its he she they we you i his her their my your our who which what when where why how because since although while so as than then there about after before into over more some many very would could will can".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber in im am an auf aus bei mit nach von vor zu zum zur für über unter ist sind war waren hat haben hatte habe wird wurde nicht dass weil als wie wer wo wann warum sie er es ich wir ihr sein seine mein meine sich so auch noch schon sehr viel dort danach seit einigen".split(),
    "fr": "le la les l un une des du de d et ou mais dans en au aux à avec pour par sur sous est sont était a ont avait ne pas que qui quoi quand où pourquoi parce il elle ils elles je nous vous on son sa ses mon ma mes se ce cette ces très plus y depuis quelques trop ensuite".split(),
    "es": "el la los las un una unos unas de del y o pero en al con por para sin sobre es son era fue está están ha han había no que quien cuando dónde porque él ella ellos ellas yo nosotros su sus mi mis se lo le muy más allí después desde hace demasiado mucho".split(),
    "it": "il lo la gli i le un una di del della e o ma in nel con per su non che chi quando dove perché è sono era ha hanno si sì suo sua molto più alla dal dopo anche poco stata stato insieme tutta".split(),
    "pt": "o a os as um uma de do da dos das e ou mas em no na nos nas com por para não que quem quando onde porque é são foi está tem seu sua muito mais ela ele".split(),
    "nl": "ja nee waarschijnlijk wel erg de het een en of maar in op aan met van voor naar bij is zijn was waren heeft hebben niet dat die wie wat wanneer waar waarom omdat hij zij ze wij er ook nog heel".split(),
}
_LANGUAGES = {}
for _lang, _words in _FUNCTION.items():
    for _w in _words:
        _LANGUAGES.setdefault(_w, set()).add(_lang)

# Words with which no statement ends.
_NEVER_LAST = frozenset("the a an and or but because although if than as very le un une et ou mais très der ein eine einen einem und oder aber weil dass y o pero porque muy el los las unos".split())
# Words with which a statement seldom ends; how it goes on elsewhere decides.
_SELDOM_LAST = frozenset(
    """of in at for with from by since while that which who whose when where into onto over under between about before after during until is are
    was were be been has have had does did to not so too both either my your his her our their these those some any every each no such what how why still
    die das den dem des im am an auf aus bei mit nach von vor zu zum zur für über als wie wenn ob ist sind war hat haben sehr viel seit einigen
    la les des du de dans en au aux à avec pour par sur est sont était ont ne que qui quand trop depuis quelques son sa ses ce cette
    una del al con por para sin sobre es son era que cuando demasiado desde su sus hace""".split()
)


def plain(text: str | None) -> str:
    if text is None or text.isascii():
        return (text or "").strip()
    return _INVISIBLE.sub("", unicodedata.normalize("NFC", text or "")).replace("’", "'").replace("‘", "'").strip()


def is_empty(text: str | None) -> bool:
    """Nothing visible, only punctuation, or a marker of a missing value."""
    t = plain(text)
    low = re.sub(r"\s+", " ", t.lower())
    return not any(c.isalnum() for c in t) and not any(unicodedata.category(c) in ("So", "Sc") for c in t) or low in MISSING or low.strip(" .!'\"()[]<>{}") in ("null", "none", "nan", "n/a", "nil", "undefined")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(plain(text))]


def is_copy(question: str | None, answer: str) -> bool:
    """The question again, perhaps with a label before or after it, and no answer."""
    q = _asked(question)[1]
    a = tokens(answer)
    if not q or len(a) < len(q):
        return False
    labels = {"question", "answer", "q", "a", "frage", "antwort", "réponse", "pregunta", "respuesta", "you", "asked"}
    rest, i = [], 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            i += len(q)
        else:
            rest.append(a[i])
            i += 1
    return len(rest) < len(a) and all(w in labels for w in rest)


def _script(text: str) -> str:
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    counts: Counter = Counter()
    for c, n in Counter(filter(str.isalpha, text)).items():
        counts["latin" if c < "\u0250" or "\u1e00" <= c < "\u1f00" else unicodedata.name(c, "?").split()[0].lower()] += n
    return counts.most_common(1)[0][0] if counts else ""


_LETTERS = re.compile(r"[^\W\d_]+")
# Titles and names are loan words in any language.
_QUOTED = re.compile("\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|‹[^›]*›|「[^」]*」|『[^』]*』")
_NAMES = re.compile(r"(?<=[^\W\d_] )[^\W\d_a-z][\w'’-]*(?: [^\W\d_a-z][\w'’-]*)+")
_MARKS = (("de", frozenset("äöüß")), ("fr", frozenset("éèêàçùœ")), ("es", frozenset("ñ¿¡óáí")))


def _language_scores(text: str) -> Counter:
    """Function words of each language in a tidied text; a word of several languages counts a share for each."""
    low = text.lower()
    scores: Counter = Counter()
    for w in _LETTERS.findall(low):
        if langs := _LANGUAGES.get(w):
            for lang in langs:
                scores[lang] += 1 / len(langs)
    if scores and not low.isascii():
        for lang, marks in _MARKS:
            if n := len(marks.intersection(low)):
                scores[lang] += 0.4 * n
    return scores


def _own_words(answer: str) -> str:
    """An answer without what it quotes; one that is all quotation stays whole."""
    if (left := _QUOTED.sub(" ", answer)) != answer and _LETTERS.search(left):
        return left
    return answer


def _is_name(text: str) -> bool:
    """Words that all begin with a capital letter, in a script that has them."""
    words = _LETTERS.findall(text)
    return bool(words) and len(words) <= 4 and all(w[0] != w[0].lower() for w in words)


@functools.lru_cache(maxsize=5_000)
def _asked(question: str | None) -> tuple[str, list[str], str, frozenset, str | None, str]:
    """Tidied question, its words, script, words but for function words, language and template; pairs of one question share them."""
    q = plain(question)
    scores, words = _language_scores(q), tokens(q)
    return q, words, _script(q), frozenset(w for w in words if w not in _LANGUAGES), scores.most_common(1)[0][0] if scores else None, prompt_template(q)


def is_other_language(question: str | None, answer: str) -> bool:
    """Whole words of the answer belong to a language, or a script, that the question is not in."""
    q, _, script, _, own, _ = _asked(question)
    a = _own_words(plain(answer))
    words = _LETTERS.findall(a)
    if not q or sum(map(len, words)) < 4:
        return False
    if _script(a) != script:
        return not _is_name(a)
    if own is None or len(words) < 3:
        return False
    said = _language_scores(a)
    if not said:
        return False
    best, score = said.most_common(1)[0]
    least = 1.2 if not said[own] else 1.9
    return best != own and score >= least and score >= 2 * said[own] + 0.5 and score >= 0.15 * len(words)


_TERMINAL = frozenset(".!?。！？")


def declines(answer: str) -> bool:
    t = re.sub(r"\s+", " ", plain(answer))
    return bool(_DECLINES.search(t) or _ANYWHERE.search(t))


_MARKED = frozenset("#_")
# A word with a capital that follows another word of its sentence.
_INSIDE_CAPITAL = re.compile(r"(?<=[\w,;)'’] )[^\W\d_a-zß-öø-ÿ][\w'’-]*")


def opening(question: str | None, answer: str, usual: frozenset, lang: str = "", frequent: frozenset = frozenset()) -> str:
    """Masked first words of an answer: ``_`` for words of its question, ``#`` for numbers, ``*`` for what is new.

    New are words that are not usual ones (in a short answer: not even ``frequent``), and names (a capital inside a
    sentence, but not in German).  If little is left of an opening, the words that are not of the question keep their form.
    """
    asked, text = _asked(question)[3], plain(answer)
    words = _WORD.findall(text)
    if len(words) <= SHORT_WORDS:
        usual = frequent or usual
    names = set() if lang == "de" else {w.lower() for w in _INSIDE_CAPITAL.findall(text)} - _LANGUAGES.keys()
    found = ["#" if w[0].isdigit() else "_" if w in asked else w for w in map(str.lower, words[:OPENING_WORDS])]
    masked = [w if w in _MARKED or w in usual and w not in names else "*" for w in found]
    return " ".join(masked if 2 * (masked.count("_") + masked.count("*")) <= len(masked) else found)


def prompt_template(question: str | None) -> str:
    """The first function words of a question, by which unrelated prompts differ."""
    return " ".join([w if w in _LANGUAGES else "_" for w in tokens(question or "")][:6])


_CLOSING = "\"'”’»)]*"


def cut_off(answer: str) -> bool | None:
    """True if an answer visibly stops too early, False if it ends with a full stop, None if it has no end mark."""
    t = plain(answer)
    if not t:
        return False
    if t.endswith(("…", "...", "..")):
        return True
    if t[-1] in ",;:-–—(&/=+[{<“„«":
        return True
    # A list marker without its item, after an item; a number by itself is an answer.
    if re.search(r"\n\s*\d+[.)]$", t):
        return True
    if t.count("“") > t.count("”") and "”" not in t and '"' not in t or t.count("(") > t.count(")") or t.count("«") > t.count("»"):
        return True
    if t.count('"') % 2:
        return True
    if t.rstrip(_CLOSING)[-1:] in _TERMINAL:
        return False
    words = _WORD.findall(t)
    return True if len(words) > 1 and words[-1].lower() in _NEVER_LAST and words[-1] not in ("A", "I") else None


def mask(word: str, frequent: frozenset, first: bool) -> str:
    low = word.lower()
    if low[0].isdigit():
        return "#"
    if word[0].isupper() and not first:
        return "N"
    return low if low in frequent else "R"


_SENTENCE = re.compile(r"[^.!?。！？…\n]+[.!?。！？…]*")


def _ngrams(answers: list[tuple[str, int]], frequent: frozenset) -> dict[tuple[str, str], list[int]]:
    """(kind, key) -> [inside, at the end] over the sentences that end with a full stop.

    Kinds: masked runs of ``2`` and ``3`` words, each word ``w``, and each word with the one before it ``b``.
    """
    seen: dict[tuple[str, str], list[int]] = {}
    for answer, times in answers:
        for sentence in _SENTENCE.findall(plain(answer)):
            words = _WORD.findall(sentence)
            ended = sentence.rstrip()[-1:] in _TERMINAL and not sentence.rstrip().endswith("..")
            masked = [mask(w, frequent, i == 0) for i, w in enumerate(words)]
            low = [w.lower() for w in words]
            for i in range(len(words) if ended else len(words) - 1):
                final = i == len(words) - 1
                seen.setdefault(("w", low[i]), [0, 0])[final] += times
                if i:
                    seen.setdefault(("2", f"{masked[i - 1]} {masked[i]}"), [0, 0])[final] += times
                    seen.setdefault(("b", f"{low[i - 1]} {low[i]}"), [0, 0])[final] += times
                if i > 1:
                    seen.setdefault(("3", " ".join(masked[i - 2 : i + 1])), [0, 0])[final] += times
    return seen


#: Answers whose n-grams a task holds at once.
NGRAM_ROWS = 5000


def _count_ngrams(frequent_of):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, NGRAM_ROWS):
                part = batch.slice(start, NGRAM_ROWS)
                seen = _ngrams(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), frequent_of.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]],
                    ["kind", "gram", "inside", "final"],
                )

    return count


@functools.lru_cache(maxsize=2)
def _beginnings(words: frozenset) -> frozenset:
    """Proper beginnings of two letters or more of the words."""
    return frozenset(w[:k] for w in words for k in range(2, len(w)))


_CHECKED = "row bigint, pair_table string, pair_id bigint, defect string, cut int, declined boolean, opening string, lang string, prompt string, gram3 string, gram2 string, last string, begun string, stub boolean"


def _check(frequent_of, usual_of):
    def one(question: str | None, answer: str | None) -> tuple:
        if is_empty(answer):
            return ("empty", 0, False, "", "", "", None, None, None, None, False)
        if is_copy(question, answer):
            return ("copied_question", 0, False, "", "", "", None, None, None, None, False)
        asked, text = _asked(question)[1], plain(answer)
        # An answer may repeat its question first; what follows is the answer.
        said = text
        if asked and tokens(text)[: len(asked)] == asked:
            parts = re.split(r"[?？]\s*", text, maxsplit=1)
            said = parts[1] if len(parts) == 2 and parts[1].strip() else text
        ends = cut_off(text)
        declined = declines(said)
        grams, stub = [None] * 4, False
        code = {True: 1, False: 0, None: 2}[ends]
        if ends is None:
            # What stands after the last full stop or colon, by itself a phrase or a sentence.
            last = re.split(r"[.!?。！？\n]\s*|:\s+", text)[-1]
            words = _WORD.findall(last)
            masked = [mask(w, frequent_of.value, i == 0) for i, w in enumerate(words)]
            if len(words) >= 2 and words[-1].lower() in _SELDOM_LAST:
                code = 3
            if len(words) >= 3 or code == 3:
                grams[:2] = " ".join(masked[-3:]), " ".join(masked[-2:])
            # Shorter ones can only end in a cut word; a capital letter of a lone word may begin a name.
            if words and len(words[-1]) > 1 and words[-1].isalpha() and (len(words) > 1 or words[-1].islower()):
                grams[2] = words[-1].lower()
                grams[3] = f"{words[-2].lower()} {grams[2]}" if len(words) > 1 else None
                stub = grams[2] not in frequent_of.value and grams[2] in _beginnings(frequent_of.value)
        other = "other_language" if is_other_language(question, said) else None
        scores = _language_scores(said)
        lang = scores.most_common(1)[0][0] if scores else ""
        return (other, code, declined, opening(question, said, usual_of.value, lang, frequent_of.value), lang, _asked(question)[5], *grams, stub)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(q, a) for q, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            kinds = (pa.string(), pa.int32(), pa.bool_(), *[pa.string()] * 7, pa.bool_())
            names = [part.split()[0] for part in _CHECKED.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return check


def cluster_openings(openings: DataFrame) -> DataFrame:
    """``opening, template``: distinct openings with the number of their cluster, that of its least member.

    An opening is known by its 64-bit hash; one without a near-equal other is a template of its own.
    """
    nodes = materialize(openings.select("opening", F.xxhash64("opening").alias("node"), shingles(F.col("opening")).alias("shingles")), "openings")
    links = similar_links(nodes)
    roots = components(links)
    labels = nodes.join(roots, "node", "left").select("opening", F.coalesce("root", "node").alias("template"))
    labels = materialize(labels, "templates")
    discard(nodes, links, roots)
    return labels


def refusing_by_words(labels: DataFrame, templates: DataFrame, asked_with: DataFrame) -> DataFrame:
    """``template`` of the recurring clusters that don't decline in the phrases of ``declines``, but are worded like those that do.

    ``labels``: ``opening, template``; ``templates``: ``template, lang, declining, recurring, vacant``; ``asked_with``: ``opening,
    prompt, n``.  The words of each template are weighed by all others of its language (smoothed log odds of a declining
    one; a word that none of those has speaks for nothing), and its answers must be spread over the prompts as evenly as
    over ``UNRELATED_PROMPTS`` equal ones.  A template whose answers say something new ("The answer is Ann.") is none.
    """
    words = labels.join(templates, "template").select("template", "lang", "declining", "recurring", "vacant", F.explode(F.split("opening", " ")).alias("word")).filter("word not in ('_', '#', '*', '')").distinct()
    words = materialize(words, "words")
    of_lang = templates.groupBy("lang").agg(F.sum(F.col("declining").cast("long")).alias("lang_yes"), F.count("*").alias("lang_all"))
    known = words.groupBy("lang", "word").agg(F.sum(F.col("declining").cast("long")).alias("yes"), F.count("*").alias("all"))
    # A template judged here is one that doesn't decline; it is left out of the counts.  One row a language: broadcast.
    own = words.filter("recurring and vacant and not declining").join(known.filter("all > 1"), ["lang", "word"]).join(F.broadcast(of_lang), "lang")
    odds = F.log((F.col("yes") + 0.5) / (F.col("lang_yes") + 1)) - F.log((F.col("all") - F.col("yes") - 1 + 0.5) / (F.col("lang_all") - F.col("lang_yes") + 1))
    odds = F.when(F.col("yes") > 0, odds).otherwise(F.least(odds, F.lit(0.0)))
    worded = own.groupBy("template").agg(F.sum(odds).alias("odds"), F.count("*").alias("n_words")).filter((F.col("odds") >= REFUSING_WORDS) & (F.col("odds") >= REFUSING_WORD * F.col("n_words")))
    each = asked_with.join(labels.join(worded.select("template"), "template"), "opening").groupBy("template", "prompt").agg(F.sum("n").alias("n"))
    # The entropy of equal shares of UNRELATED_PROMPTS prompts; a little less, as sums are not exact.
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return each.groupBy("template").agg(entropy.alias("entropy")).filter(F.col("entropy") >= math.log(UNRELATED_PROMPTS) - 1e-9).select("template")


def _endings(checked: DataFrame, answers: DataFrame, frequent) -> DataFrame:
    """``row, early, ends_so`` of the answers without an end mark: do their last words end sentences anywhere?

    ``answers(answer, times)`` are the distinct answers, whose words are counted whole; beginnings of words are taken
    from the counted words, not from the texts, and only those are kept that some answer ends in.
    """
    grams = in_arrow(spread(answers), _count_ngrams(frequent), "kind string, gram string, inside bigint, final bigint")
    grams = materialize(grams.groupBy("kind", "gram").agg(F.sum("inside").alias("inside"), F.sum("final").alias("final")), "grams")
    ends = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("gram")) for k, c in (("3", "gram3"), ("2", "gram2"), ("w", "last"), ("b", "begun"), ("p", "begun"))])
    asked = checked.filter("cut >= 2").select("row", "stub", F.inline(ends)).filter("gram is not null")
    wanted = materialize(asked.select("kind", "gram").distinct(), "wanted")
    before = F.length(F.substring_index("gram", " ", 1))
    longer = F.transform(F.sequence(before + 3, F.length("gram") - 1), lambda n: F.substring(F.col("gram"), F.lit(1), n))
    begun = grams.filter((F.col("kind") == "b") & (F.length("gram") > before + 3)).select(F.lit("p").alias("kind"), F.explode(longer).alias("gram"), "inside", "final")
    begun = begun.join(wanted, ["kind", "gram"], "left_semi").groupBy("kind", "gram").agg(F.sum("inside").alias("inside"), F.sum("final").alias("final"))
    counted = grams.join(wanted, ["kind", "gram"], "left_semi").unionByName(begun)
    known = asked.join(counted, ["kind", "gram"], "left")
    seen = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    endings = known.groupBy("row").agg(
        F.max("stub").alias("stub"),
        F.max(F.when(F.col("kind") == "p", 1)).isNotNull().alias("after"),
        F.max(F.when(F.col("kind") == "w", 1)).isNotNull().alias("word"),
        *[seen(k, c).alias(f"{c}{k}") for k in "32wbp" for c in ("inside", "final")],
    )

    def unusual(k: str) -> Column:
        inside, final = F.col(f"inside{k}"), F.col(f"final{k}")
        return (inside >= ENDING_SEEN) & (final < ENDING_SHARE * (inside + final))

    def usual(k: str) -> Column:
        inside, final = F.col(f"inside{k}"), F.col(f"final{k}")
        return (final >= 2) & (final >= 0.02 * (inside + final))

    times = lambda k: F.col(f"inside{k}") + F.col(f"final{k}")
    known3 = times("3") >= ENDING_SEEN
    unknown_word = F.col("word") & (times("w") == 0) & ((times("p") >= 2) | F.col("stub"))
    cut_word = F.col("after") & (times("b") == 0) & (times("p") >= CUT_WORD_SEEN)
    return endings.select(
        "row",
        (F.when(known3, unusual("3")).otherwise(unusual("2")) | unknown_word | cut_word).alias("early"),
        F.when(known3, usual("3")).otherwise(usual("2")).alias("ends_so"),
    )


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_table, pair_id, defect`` of every broken pair of ``pairs(pair_table, pair_id, question, answer)``.

    One defect for each pair, the first that holds of: empty, copied_question, refusal, other_language, truncated.
    A pair without a question can't be a copy or of another language; rows with a null or repeated id are judged each
    by itself; an empty table gives no rows.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("pair_table", F.col("pair_id").cast("bigint").alias("pair_id"), "question", "answer")
    # A number of its own for each row: ids may be null or repeated.  It is fixed as the rows are written.
    pairs = materialize(spread(pairs).select(F.monotonically_increasing_id().alias("row"), "*"), "pairs")
    answers = pairs.filter("answer is not null").groupBy("answer").agg(F.count("*").alias("times"))
    words = pairs.filter("answer is not null").select(F.explode(F.split(F.lower("answer"), r"[^\p{L}\p{N}'’-]+")).alias("w")).filter("w <> ''")
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(FREQUENT_WORDS).collect()
    frequent = spark.sparkContext.broadcast(frozenset(r.w for r in top))
    usual_words = spark.sparkContext.broadcast(frozenset(r.w for r in top[:OPENING_FREQUENT]))
    checked = materialize(in_arrow(pairs, _check(frequent, usual_words), _CHECKED), "checked")
    early = _endings(checked, answers, frequent)

    asked_with = checked.filter("opening <> ''").groupBy("opening", "prompt").agg(F.max("lang").alias("lang"), F.count("*").alias("n"), F.sum(F.col("declined").cast("int")).alias("n_declined"))
    asked_with = materialize(asked_with, "distinct")
    openings = asked_with.groupBy("opening").agg(F.max("lang").alias("lang"), F.sum("n").alias("n"), F.sum("n_declined").alias("n_declined"))
    labels = cluster_openings(openings.select("opening"))
    # A template needs to be seen with a few prompts only, so no more than those of each opening are counted.
    some = asked_with.withColumn("nth", F.row_number().over(Window.partitionBy("opening").orderBy("prompt"))).filter(F.col("nth") <= UNRELATED_PROMPTS)
    prompts = some.join(labels, "opening").select("template", "prompt").distinct().groupBy("template").agg(F.count("*").alias("n_prompts"))
    n_new = F.sum(F.when(F.col("opening").rlike(r"(^| )[*#]( |$)"), F.col("n")).otherwise(0)).alias("n_new")
    templates = openings.join(labels, "opening").groupBy("template").agg(F.max("lang").alias("lang"), F.sum("n").alias("n"), F.sum("n_declined").alias("n_declined"), n_new).join(prompts, "template")
    declining = F.col("n_declined") >= DECLINING_SHARE * F.col("n")
    templates = materialize(templates.select("template", "lang", declining.alias("declining"), (F.col("n_prompts") >= UNRELATED_PROMPTS).alias("recurring"), (F.col("n_new") <= NEW_SHARE * F.col("n")).alias("vacant")), "votes")
    worded = refusing_by_words(labels, templates, asked_with).withColumn("worded", F.lit(True))
    verdict = F.when(F.col("recurring"), F.col("declining"))
    verdicts = labels.join(templates, "template").join(worded, "template", "left").select("opening", verdict.alias("refuses"), F.coalesce("worded", F.lit(False)).alias("worded"))

    judged = checked.join(verdicts, "opening", "left").join(early, "row", "left")
    # An answer in another language is none in the words of refusals of its question's language, and of one that visibly
    # stops too early the words that are missing might say something new.
    refuses = F.coalesce("refuses", "declined") | F.coalesce(F.col("worded") & F.col("defect").isNull() & (F.col("cut") != 1), F.lit(False))
    defect = (
        F.when(F.col("defect").isin("empty", "copied_question"), F.col("defect"))
        .when(refuses, "refusal")
        .when(F.col("defect") == "other_language", F.col("defect"))
        .when((F.col("cut") == 1) | ((F.col("cut") == 2) & F.coalesce("early", F.lit(False))) | ((F.col("cut") == 3) & ~F.coalesce("ends_so", F.lit(False))), "truncated")
    )
    return judged.select("pair_table", "pair_id", defect.alias("defect")).filter("defect is not null")


def qa_and_prediction_pairs(qa_items: DataFrame, predictions: DataFrame) -> DataFrame:
    """All pairs of the two tables; a prediction finds its question by ``qid``.

    Redelivered rows are one pair, the earliest; each row with a null id is a pair of its own.
    """
    def first(df: DataFrame, key: str, cols: list[str], at: str) -> DataFrame:
        known = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.coalesce(F.col(at).cast("string"), F.lit("9")), *cols)).alias("r")).select(key, *[f"r.{c}" for c in cols])
        return known.unionByName(df.filter(F.col(key).isNull()).select(key, *cols))

    qa = first(qa_items, "qid", ["question", "gold_answer"], "ingested_at")
    said = first(predictions, "pred_id", ["qid", "answer_text"], "predicted_at")
    of_qa = qa.select(F.lit("qa_items").alias("pair_table"), F.col("qid").alias("pair_id"), "question", F.col("gold_answer").alias("answer"))
    of_predictions = said.join(qa.select("qid", "question"), "qid", "left").select(F.lit("predictions").alias("pair_table"), F.col("pred_id").alias("pair_id"), "question", F.col("answer_text").alias("answer"))
    return of_qa.unionByName(of_predictions)
