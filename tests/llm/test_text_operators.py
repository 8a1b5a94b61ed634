import pytest

from memloom.llm import pairs as P
from memloom.llm.pairs import broken_pairs, cluster_openings
from memloom.llm.pii import Names, find_spans, redact, spans_of, tidy
from memloom.llm.spam import LineModel, lines_of, spam_pages, spam_share

NAMES = [(f"{a}{b}", "family") for a in ("Brem", "Corv", "Hask", "Lund", "Vell") for b in ("amere", "istad", "oquist", "ewick", "ingson", "erard")] + [(n, "given") for n in "Keldan Keledo Tavido Tavana Joy Will Sunedo Sunana".split()] + [("Park", "family"), ("O'Marrin", "family")]


def found(text):
    return {(s.kind, text[s.start : s.end]) for s in spans_of(text, Names.of(NAMES))}


@pytest.mark.parametrize(
    "text, want",
    [
        ("my mail is k.d+x@post.example, ok", ("email", "k.d+x@post.example")),
        ("write to kd (at) post [dot] example now", ("email", "kd (at) post [dot] example")),
        ("Contact: <a.b AT inbox DOT test>", ("email", "a.b AT inbox DOT test")),
        ("Call me on +44 (0)20 7946 0429 tonight", ("phone", "+44 (0)20 7946 0429")),
        ("Text two zero two five five five zero one two three!", ("phone", "two zero two five five five zero one two three")),
        ("my social is 984921025", ("id_number", "984921025")),
        ("They asked for it again, it's 957-52-5677.", ("id_number", "957-52-5677")),
        ("New place: Flat 3, 307 Kiln Lane", ("street_address", "Flat 3, 307 Kiln Lane")),
        ("We live at Forty-one Copper Row now", ("street_address", "Forty-one Copper Row")),
        ("Nous habitons 7 bis avenue du Vieux Port.", ("street_address", "7 bis avenue du Vieux Port")),
        ("Ship it to P.O. Box 98, Town", ("street_address", "P.O. Box 98")),
        ("I met Dr. Lundamere today", ("person_name", "Lundamere")),
        ("Ask T. Corvistad's office", ("person_name", "T. Corvistad")),
        ("They put Velloquist, Keldan on the list", ("person_name", "Velloquist, Keldan")),
        ("her national ID, AB123456C, was leaked", ("id_number", "AB123456C")),
        ("Her ID, issued in Spain, reads 12345678Z", ("id_number", "12345678Z")),
        ("Passnummer C01X00T47", ("id_number", "C01X00T47")),
        ("We stayed at via Roma 12, Milano", ("street_address", "via Roma 12")),
        ("I live at 12 Oak Trail now", ("street_address", "12 Oak Trail")),
        ("Call five-five-five-zero-one-two-three please", ("phone", "five-five-five-zero-one-two-three")),
        ("I'm at twelve Alder Street's back door", ("street_address", "twelve Alder Street")),
    ],
)
def test_spans(text, want):
    assert want in found(text)


@pytest.mark.parametrize("text", ["Keldan came home", "I planted 27 alder trees", "The order number is #4003-IV", "Check D11:17 and D8:3", "We scored 18-1 and 110-98", "They sang for 20 people. New place to sing", "follow @keldan8", "version v2.3-beta@stable", None, "", "   "])
def test_no_spans(text):
    assert [s for s in spans_of(text, Names.of(NAMES)) if sum(s.votes) > 0] == []


def test_places_survive_tidying():
    text = "my​ mail: k­e@post.example"
    plain, places = tidy(text)
    assert plain == "my mail: ke@post.example"
    s = [x for x in spans_of(text, Names.of(NAMES)) if x.kind == "email"][0]
    assert text[s.start : s.end] == "k­e@post.example"


def test_prefilters_lose_nothing(monkeypatch):
    from memloom.llm import pii

    texts = ["Call five-five-five-zero-one-two-three please", "I'm at twelve Alder Street's back door", "ping-jane at post.example", "ask J.Velloquist", "Ask T. Corvistad's office", "we met at noon", "Lundamere-Brem, Keldan", "von der Hask", "12 Oak", "Mr Smith", "O'Marrin's"]
    texts += [" ".join(t) for t in zip(texts, reversed(texts))] + [t.upper() for t in texts] + [t.lower() for t in texts]
    names = Names.of(NAMES)
    filtered = [spans_of(t, names) for t in texts]
    monkeypatch.setattr(pii, "_possible", lambda plain, names: (True, True, True, [pii._STREET, pii._RUE, pii._CALLE, pii._STRASSE, pii._BOX], True))
    assert filtered == [spans_of(t, names) for t in texts]


def test_shape_of_names_is_learned():
    names = Names.of([n for n in NAMES if n[0] != "Lundoquist"], "the market harbour yesterday because weather bicycle kitchen garden evening morning wonderful".split())
    assert names.family_vote("Lundoquist") == 2 and names.family_vote("Velloquist") == 1
    assert not any(names.family_vote(w) for w in ("bicycle", "kitchen", "Keldan", "evening"))


def test_check_digits():
    from memloom.llm.pii import _check_digit, _isbn

    assert _check_digit("12345678Z") and not _check_digit("12345678A") and _check_digit("X1234567L")
    assert _check_digit("2 69 05 49 588 157 80") and _check_digit("86095742719") and not _check_digit("86095742718")
    assert _isbn("9780306406157") and not _isbn("9780306406158")


PERSONAL = [f"my mail is user{i}@post.example, it works" for i in range(30)] + [f"Call me on +44 7700 9003{i:02d} tonight" for i in range(30)] + ["I hope May will be warmer."] * 30


def test_found_and_redacted(spark):
    texts = PERSONAL
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (500, None, 0), (501, "", 0), (502, "x " * 50000, 0)]
    df = spark.createDataFrame(rows, "turn_id bigint, text string, score int")
    names = spark.createDataFrame(NAMES, "name_text string, name_kind string")
    spans = find_spans(df, names).collect()
    assert sorted((r.turn_id, r.pii_type, r.start_pos) for r in spans) == sorted([(i, "email", 11) for i in range(30)] + [(i, "phone", 11) for i in range(30, 60)])
    redacted = redact(df, names).collect()
    out = {r.turn_id: r.text for r in redacted}
    assert out[3] == "my mail is [EMAIL], it works" and out[35] == "Call me on [PHONE] tonight" and out[500] is None and out[501] == "" and out[70] == texts[70]
    assert len(redacted) == len(rows) and sum(r.turn_id == 0 for r in redacted) == 2
    assert find_spans(df.limit(0), names).count() == 0 and find_spans(df, names.limit(0)).count() == 60 and redact(df.limit(0), names).count() == 0


def test_redaction_does_not_hang_on_ids(spark):
    """Rows without an id, and two texts of one id, are each redacted by their own text."""
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(None, "Mail me at jane.miller@example.com today"), (None, None), (7, "Now it is new.user7@post.example, write there"), (7, "nothing here")]
    df = spark.createDataFrame(rows, "turn_id bigint, text string")
    names = spark.createDataFrame(NAMES, "name_text string, name_kind string")
    out = [(r.turn_id, r.text) for r in redact(df, names).collect()]
    assert len(out) == len(rows) and sorted(t for i, t in out if i == 7) == ["Now it is [EMAIL], write there", "my mail is [EMAIL], it works", "nothing here"]
    assert sorted(str(t) for i, t in out if i is None) == ["Mail me at [EMAIL] today", "None"]
    spans = find_spans(df, names).collect()
    assert (None, "email", 11) in {(r.turn_id, r.pii_type, r.start_pos) for r in spans} and sum(r.turn_id == 7 for r in spans) == 2
    # Round trip: what stands outside the places is unchanged.
    again = {r.text for r in redact(spark.createDataFrame(out, "turn_id bigint, text string"), names).collect()}
    assert again == {t for _, t in out}


def test_large_gazetteers_are_joined(spark, monkeypatch):
    from memloom.llm import pii

    texts = [f"I met {t} Lundamere{s} today, it was fine number {i}" for i, (t, s) in enumerate(zip(["Dr.", "Keldan", "T.", "Mrs."] * 10, ["", "'s", "", ","] * 10))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "Ask Tavido O'Marrin about it")], "turn_id bigint, text string")
    names = spark.createDataFrame(NAMES, "name_text string, name_kind string")
    want = sorted(map(str, find_spans(df, names).select("turn_id", "pii_type", "start_pos").collect()))
    monkeypatch.setattr(pii, "MAX_NAMES", 3)
    assert sorted(map(str, find_spans(df, names).select("turn_id", "pii_type", "start_pos").collect())) == want and len(want) >= 40


@pytest.mark.parametrize(
    "question, answer, want",
    [
        ("When?", None, "empty"),
        ("When?", " ​", "empty"),
        ("When?", "N/A", "empty"),
        ("When?", "…", "empty"),
        ("When did Ann move?", '"when did ann move"', "copied_question"),
        ("When did Ann move?", "When did Ann move?\nAnswer:", "copied_question"),
        ("When did Ann move?", "I'm sorry, but the context does not mention this.", "refusal"),
        ("Wann ist Ann umgezogen?", "Das weiß ich leider nicht.", "refusal"),
        ("¿Cuándo se mudó Ann?", "No lo sé.", "refusal"),
        ("Why did Ann move?", "Weil die neue Wohnung viel zu klein für zwei Räder ist.", "other_language"),
        ("Why did Ann move?", "彼女は音楽が大好きですから。", "other_language"),
        ("Why did Ann move?", "Because the rent went up and the", "truncated"),
        ("Why did Ann move?", "Because the rent...", "truncated"),
        ("Why did Ann move?", "1. chess\n2. pottery\n3.", "truncated"),
        ("Why did Ann move?", "Ann gave Bo a tent (bought in", "truncated"),
        ("When did Ann move?", "When did Ann move? In May.", None),
        ("Who?", "An unknown collector from Lindemont.", None),
        ("Why did Ann move?", "Because Ann was unable to reach Bo by phone that evening.", None),
        ("How many?", "Zero", None),
        ("Where?", "the lake house", None),
        (None, "the lake house", None),
    ],
)
def test_defects(spark, question, answer, want):
    df = spark.createDataFrame([("t", 1, question, answer)], "pair_table string, pair_id bigint, question string, answer string")
    if want in ("empty", "copied_question", "refusal"):
        got = "empty" if P.is_empty(answer) else "copied_question" if P.is_copy(question, answer) else "refusal" if P.declines(answer) else None
    elif want == "other_language":
        got = want if P.is_other_language(question, answer) else None
    elif want == "truncated":
        got = want if P.cut_off(answer) else None
    else:
        got = "bad" if P.is_empty(answer) or P.is_copy(question, answer) or P.declines(answer) or P.is_other_language(question, answer) or P.cut_off(answer) else None
    assert got == want and df is not None


def test_pairs_together(spark):
    rows = [("t", i, f"Where did person{i} buy the tent?" if i % 2 else f"Why was it {i}?", "At a market in the old town near the river.") for i in range(40)]
    rows += [("t", 100 + i, q, "I am unable to say, please provide more details about this topic.") for i, q in enumerate(["Who?", "Where did it happen?", "Why was it so?", "When will they go?"])]
    rows += [("t", 200, "Where?", "At a market in the old"), ("t", 201, None, None), ("p", 201, "Where?", "x" * 20000)]
    got = {(r.pair_table, r.pair_id): r.defect for r in broken_pairs(spark.createDataFrame(rows, "pair_table string, pair_id bigint, question string, answer string")).collect()}
    assert got == {("t", 200): "truncated", ("t", 201): "empty"} | {("t", 100 + i): "refusal" for i in range(4)}
    assert broken_pairs(spark.createDataFrame([], "pair_table string, pair_id bigint, question string, answer string")).count() == 0


SAID_THROUGH_PAIRS = [
    ("When did Ann move?", 'The song "Über den Dächern".', None),
    ("Where did Ann eat?", 'A café called "Les Brumes de la Mer".', None),
    ("When did Ann move?", "2024.", None),
    ("How many weeks did it take?", "38.", None),
    ("How many weeks did it take?", "According to the context: Zero", None),
    ("When did Ann move?", "According to the context: October 2019", None),
    ("Who was it?", "According to the context: Bo", None),
    ("Who was it?", "Ольга Петрова", None),
    ("Where did Ann buy the tent?", "Déjà vu in the old town.", None),
    ("Where did Ann buy the tent?", "At a market in the old town near the ri", "truncated"),
    ("Where did Ann buy the tent?", "a mark", "truncated"),
    ("What did Ann do?", "1. chess\n2. pottery\n3.", "truncated"),
    ("When did Ann move?", "C'est la vie, elle est très heureuse !", "other_language"),
    ("When did Ann move?", "«Wir haben das Geschenk auf dem Markt gekauft und nach Hause gebracht.»", "other_language"),
    (None, "2024.", None),
]


def test_defects_through_broken_pairs(spark):
    sound = [("t", 1000 + i, f"Where did person{i} buy the tent?", "At a market in the old town near the river. According to the context of the talk it was fine.") for i in range(60)]
    rows = [("t", i, q, a) for i, (q, a, _) in enumerate(SAID_THROUGH_PAIRS)]
    # Rows without an id, or with one that is repeated, are judged each by itself.
    apart = [("t", None, "Where?", "null"), ("t", None, "Where?", "At a market in the old town near the river."), ("t", 900, "Where?", ""), ("t", 900, "Where?", "At a market in the old town near the river.")]
    df = spark.createDataFrame([(*r, "x") for r in rows + sound + apart], "pair_table string, pair_id bigint, question string, answer string, row string")
    got = [(r.pair_id, r.defect) for r in broken_pairs(df).collect()]
    assert sorted(got, key=str) == sorted([(i, d) for i, (_, _, d) in enumerate(SAID_THROUGH_PAIRS) if d] + [(None, "empty"), (900, "empty")], key=str)


def test_null_ids_are_pairs_of_their_own(spark):
    from memloom.llm.pairs import qa_and_prediction_pairs

    qa = spark.createDataFrame([(1, "Q1", "a", "1"), (1, "Q1", "a", "2"), (None, "Q2", "b", "1"), (None, "Q3", "c", None)], "qid bigint, question string, gold_answer string, ingested_at string")
    said = spark.createDataFrame([(5, 1, "x", "1"), (5, 1, "x", "3"), (None, 1, "y", "1"), (None, None, "z", "1")], "pred_id bigint, qid bigint, answer_text string, predicted_at string")
    got = sorted(((r.pair_table, r.question, r.answer) for r in qa_and_prediction_pairs(qa, said).collect()), key=str)
    assert got == sorted([("qa_items", "Q1", "a"), ("qa_items", "Q2", "b"), ("qa_items", "Q3", "c"), ("predictions", "Q1", "x"), ("predictions", "Q1", "y"), ("predictions", None, "z")], key=str)


@pytest.mark.parametrize("chunk", [1000, 3])
def test_links_connect_what_is_alike(spark, monkeypatch, chunk):
    """Against brute force, also where a bucket is cut into chunks."""
    from pyspark.sql import functions as F

    from memloom.llm import cluster as C

    monkeypatch.setattr(C, "CHUNK", chunk)
    said = [" ".join(f"w{j if j != i else 100 + v}" for j in range(60)) for i in (0, 20, 59) for v in range(6)] + [" ".join(f"x{i}{j}" for j in range(20)) for i in range(10)] + ["a b", "a b c"]
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "node bigint, text string").withColumn("shingles", C.shingles(F.col("text")))
    sets = {r.node: set(r.shingles) for r in nodes.collect()}
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= C.SIMILARITY * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    # The links of a pass over all members as one bucket are those of brute force.
    alike = {frozenset(m for m in sets if find(m) == find(n)) for n in sets}
    joined = {n: n for n in sets}
    for r in C.components(C.similar_links(nodes)).collect():
        joined[r.node] = r.root
    assert {frozenset(m for m in sets if joined[m] == joined[n]) for n in sets} == alike


def test_components_of_a_long_chain(spark):
    from memloom.llm.cluster import components

    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components(links.limit(0)).count() == 0


def test_openings_cluster_by_verified_similarity(spark):
    base = "i do not know the answer to this question at all my"
    rows = [(f"{base} friend{i}",) for i in range(5)] + [("something else entirely is said here today by them",)]
    got = {r.opening: r.template for r in cluster_openings(spark.createDataFrame(rows, "opening string")).collect()}
    assert len({got[f"{base} friend{i}"] for i in range(5)}) == 1 and len(set(got.values())) == 2


def test_refusals_in_words_outside_the_phrases(spark):
    asked = ["Who?", "Where did it happen?", "Why was it so?", "When will they go?", "What is in it?"]
    listed = ["the context does not mention this", "i cannot answer this question", "there is no information about this in the conversation", "the conversation does not answer this question", "i do not know, the context has no information about this"]
    listed = [f"{lead} {x}" for lead in ("sorry,", "unfortunately,", "i apologize,") for x in listed]
    new = "Sorry, the conversation leaves this question without information in the context."
    sound = [f"{a} {b} at the {c} near the river." for a in ("Ann", "Bo", "Cy") for b in ("bought a tent", "sold the old boat", "met a friend") for c in ("market", "harbour", "farm")]
    rows = [(q, a) for a in [*listed, *sound, new] for q in asked]
    df = spark.createDataFrame([("t", i, q, a) for i, (q, a) in enumerate(rows)], "pair_table string, pair_id bigint, question string, answer string")
    got = {r.pair_id: r.defect for r in broken_pairs(df).collect()}
    assert not P.declines(new) and {a for i, (q, a) in enumerate(rows) if got.get(i) == "refusal"} == {*listed, new}


def test_a_changed_word_keeps_an_opening_in_its_template(spark):
    said = "We have looked through every part of the {} and there is nothing in it that would help us with this one " + " ".join(f"so we went on to page {w} of it" for w in "one two three four five".split())
    answers = [said.format(w) for w in ("conversation", "dialogue")] + ["At a market in the old town near the river."]
    usual = frozenset(w for a in answers for w in P.tokens(a))
    openings = [P.opening("Where did Ann buy the tent?", a, usual) for a in answers]
    got = {r.opening: r.template for r in cluster_openings(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    assert openings[0] != openings[1] and got[openings[0]] == got[openings[1]] != got[openings[2]]


SPAM = {
    "keywords": "cheap notebook, best cheap notebook, cheap notebook online, buy cheap notebook, discount cheap notebook, " * 6,
    "links": "\n".join(f"[cheap notebook {i}](https://x{i}.example/a?id={i})" for i in range(12)),
    "menu": "Home > Login > Cart > Sitemap > Page 3 > Next > " * 8,
    "tags": "#cheapnotebook #buy #sale #notebook_online " * 12,
    "products": "\n".join(f"SKU1{i:04d} | notebook | sale | {i}.99 | in stock" for i in range(12)),
    "sentences": "This notebook is the best notebook for cheap notebook users who want free notebook. " * 8,
}
PROSE = "We walked along the river because the weather was so lovely, and then we talked about the old house for hours. "
FINE = {"prose": PROSE * 8, "with links": PROSE * 6 + "\n\nSee also\nhttps://a.example/x", "refrain": ("La la la, she sang to me\nand all the stars were out at sea\n" * 8), "hex": "0f3a9b" * 200, "blank": " \n ", "empty": "", "none": None}


def test_pages():
    model = LineModel()
    assert {k: spam_share(model, t) > 0.5 for k, t in SPAM.items()} == dict.fromkeys(SPAM, True)
    assert {k: spam_share(model, t) > 0.5 for k, t in FINE.items()} == dict.fromkeys(FINE, False)
    assert "".join(lines_of("x" * 5000)) == "x" * 5000


def test_pages_in_other_scripts():
    model = LineModel()
    spam = ["дешёвый ноутбук, купить дешёвый ноутбук, дешёвый ноутбук онлайн, " * 8, "Главная > Вход > Корзина > Карта сайта > Страница > Далее > " * 8, "#ноутбук #купить #скидка #магазин " * 12, "便宜 笔记本, 购买 便宜 笔记本, 便宜 笔记本 商店, " * 10]
    fine = ["Мы гуляли вдоль реки, потому что погода была хорошая, и потом долго говорили о старом доме. " * 8, "我们沿着河边散步，因为天气很好。后来我们谈了很久关于老房子的事情。" * 8, "हम नदी के किनारे टहल रहे थे क्योंकि मौसम अच्छा था और फिर हमने पुराने घर के बारे में बात की। " * 8]
    assert [spam_share(model, t) > 0.5 for t in spam] == [True] * 4 and [spam_share(model, t) > 0.5 for t in fine] == [False] * 3


def test_pages_are_computed_together_as_alone():
    """Forward-backward and Viterbi of padded groups against one page at a time."""
    import numpy as np

    from memloom.llm import spam

    r = np.random.default_rng(4)
    pages = [r.integers(0, spam._N_SYMBOLS, n) for n in (1, 7, 3, 0, 12, 7, 1)]
    model = LineModel()
    assert np.allclose(model.expected_counts(pages), sum(model.expected_counts([p]) for p in pages))
    assert [list(s) for s in model.states(pages)] == [list(model.states([p])[0]) for p in pages]
    counts = model.expected_counts(pages)
    assert np.isclose(counts[:5].sum(), 6) and np.isclose(counts[5:30].sum(), sum(len(p) for p in pages) - 6)
    better = model.updated(counts)
    assert all(np.allclose(e.sum(1), 1) for e in better.emit) and np.allclose(better.move.sum(1), 1)


def test_lines_are_described_in_few_calls():
    """Most of the time of the query is spent here: a line of prose costs a bounded number of calls, and quicker ways find what the patterns find."""
    import sys

    from memloom.llm import spam

    lines, calls = [f"{PROSE}{i} of the houses were as old as that one." for i in range(200)], 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        spam.symbols_of(lines)
    finally:
        sys.setprofile(None)
    assert calls < 30 * len(lines)
    for line in [*map(chr, range(128)), "Aa_b-C9 \x1cd", "Überall_im É9²", "ΟΔΟΣ İ", "中文 हिन्दी", ""]:
        assert spam.words_of(line) == spam._WORD.findall(line.lower())
    products = ["SKU-7", "SKU 7", "EUR 5", "GBP7", "€ 5", "$7", "£9", "9.99 |", "in stock", "123-A"]
    assert all(spam._PRODUCT.search(x) and (spam._DIGIT.search(x) and spam._GOODS.search(x) or "in stock" in x) for x in products)
    assert all(spam._MARK.search(x) for x in (" > ", " » ", " | ", " / ", " · ", " • ", " › ", " → ", "> ") if spam._BETWEEN.search(x))
    # A page of each kind has the values that the plain patterns gave.
    assert {k: spam.symbols_of(spam.lines_of(t))[:2] for k, t in SPAM.items()} == {"keywords": [375, 375], "links": [3438, 3438], "menu": [159], "tags": [510, 510], "products": [2634, 2634], "sentences": [6174, 6174]}
    assert not spam._foreign("Ça va, naïve é 1 – “2”") and not spam._foreign("–“”…") and spam._foreign("мы b") and spam._foreign("中文 a")


def test_spam_pages_of_a_table(spark):
    pages = list(SPAM.items()) + list(FINE.items())
    rows = [(i, t, 0.0) for i, (_, t) in enumerate(pages)] + [(0, SPAM["keywords"], 0.0)]
    got = sorted(r.doc_id for r in spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, spam_share double")).collect())
    assert got == [0, 0, 1, 2, 3, 4, 5]
    assert spam_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
