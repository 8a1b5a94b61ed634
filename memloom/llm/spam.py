"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

A page is cut into lines (long lines into sentences or stretches of words).  Each line is described by a few
discrete features; a hidden Markov model with the states prose, link list, tag list, menu and data labels the
lines by their features and by their neighbours.  A page is flagged if more than half of its characters are in
lines labelled link list, tag list or menu.

Whole texts are read once; what is kept of a line is one number for its features and its size.  The model starts from
beliefs about the features of each state and is fitted by expectation-maximisation on all pages: in each round every
task adds up its expected counts (pages of like lengths are computed together), and only their sums, a few hundred
numbers, reach the driver.  The beliefs weigh a fixed share of all lines, so the model is alike at every size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.workspace import in_arrow, materialize

STATES = ("prose", "link_list", "tag_list", "menu", "data")
SPAM_STATES = (1, 2, 3)

#: Rounds of expectation-maximisation, and the weight of the starting beliefs as a share of all lines.
FIT_ROUNDS = 6
PRIOR_SHARE = 0.05
#: Lines (with padding) that are computed together.
TOGETHER = 200_000
#: Lines longer than this are cut at sentence ends, and those without one at words.
LONG_LINE = 240

# Function words of the languages that the pages are mainly written in.
FUNCTION_WORDS = frozenset(
    """a about after all although an and are as at back be because been before but by can did do does each every for from
    gave had has have he her him his how i if in into is it its like most my no not of off on one or our out over own she
    so some than that the their them then there they this to too two under until up very was we were what when where
    which while who will with without would you your both nobody somebody there
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für gerade
    habe haben hat ich ihr im in ist mein meine mit nach nicht noch oder schon seit sich sie sind so um und uns viel von
    vor war warst was wenn wie wir wird wurde zu zum zur über
    au aux avec ce cette comme dans de depuis des deux du elle en est et eu il ils j je l la le les leur ma mais me mes moi
    mon n ne nous on ont ou où par pas plus pour qu que qui s sa se ses si son sont suis sur un une vous à été
    al algo con cuando de del desde donde el ella en era es esta este esto estoy fue ha hay he la las le lo los me mi muy
    no nos o para pero por que se ser si sin su sus también te tu un una uno y ya""".split()
)

# Words by which shops and link farms decorate their keywords.
SHOP_WORDS = frozenset(
    """best buy buyers bargain cheap cheapest cost deal deals discount download fast fans free latest near new offer offers
    online order price prices rated review reviews sale shop shopping store top trial users
    angebot angebote beste bestellen billig günstig kaufen kostenlos neu preis preise rabatt schnell sofort test vergleich
    acheter avis gratuit livraison meilleur meilleure moins nouveau offre pas prix promo promotion rapide réduction soldes
    télécharger barata barato barata comprar descargar descuento gratis mejor mejores nueva nuevo oferta ofertas opiniones
    precio precios rebajas rápido tienda""".split()
)

_LINK = re.compile(r"<a\s[^>]*>[^<]*(?:</a>)?|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*")
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"(?:^|\s)#[^\s#]+")
_BETWEEN = re.compile(r" [>»|/·•›→] |\s\|\s|[>»|›→]\s")
_PRODUCT = re.compile(r"\bSKU\W?\d|\b(?:EUR|USD|GBP)\s?\d|[€$£]\s?\d|\b\d+\.\d\d\s*\||\bin stock\b|\b\d{3}-[A-Z]\b")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_STOP = re.compile(r"[.!?…](?:\s|$)|[。！？।؟]")
# What a match of a costlier pattern above holds (besides a digit, of products): where it is missing, that pattern need not be tried.
_DIGIT = re.compile(r"\d")
_GOODS = re.compile(r"[€$£|-]|SKU|EUR|USD|GBP")
_MARK = re.compile(r"[>»|/·•›→]")
# Characters beyond the Latin blocks.
_BEYOND = re.compile(r"[^\0-\u024f]+")
# ASCII letters made small, and a space for what stands between words.
_SMALL = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_ENDS = frozenset(".!?…。！？\"”»)")

# Numbers of values of the features, in the order of ``_symbol``.
_SIZES = (5, 3, 5, 5, 3, 3, 3)
# Where the values of the shares begin, after the first.
_FUNCTION_EDGES, _LINK_EDGES, _SHOP_EDGES = (0.08, 0.2, 0.3), (0.02, 0.3), (0.01, 0.1, 0.25)


def lines_of(text: str) -> list[str]:
    """The lines of a page; long ones are cut at sentence ends, else after some forty words."""
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) <= LONG_LINE:
            if line.strip():
                out.append(line)
            continue
        for part in _SENTENCE.split(line):
            if len(part) <= 2 * LONG_LINE:
                if part.strip():
                    out.append(part)
                continue
            at = 0
            while at < len(part):
                end = part.find(" ", at + LONG_LINE)
                end = len(part) if end < 0 or len(part) - end < LONG_LINE // 4 else end
                out.append(part[at:end])
                at = end
    return out


def words_of(line: str) -> list[str]:
    """The words of a line, in small letters (by ``_WORD``; the quicker way for ASCII finds the same)."""
    return line.encode().translate(_SMALL).decode().split() if line.isascii() else _WORD.findall(line.lower())


def symbols_of(lines: list[str]) -> list[int]:
    """One number for each line, which stands for the values of all its features.

    The shape of a line and the repetition of the page's own words say nothing about a line full of function
    words.  Of a line in another script the function and shop words are unknown, a value that is as likely in each
    state; its other features count.  Short words, among which its function words are, are no repeated ones there,
    and repeated words say nothing where sentences end.
    """
    split = list(map(words_of, lines))
    counts = Counter(chain.from_iterable(split))
    least = max(4, 0.02 * sum(map(len, split)))
    # Content words that make up a good part of the page.
    dense = {w for w, n in counts.items() if n >= least and w not in FUNCTION_WORDS}
    out = []
    for line, words in zip(lines, split):
        n = len(words) or 1
        foreign = not line.isascii() and _foreign(line)
        own = dense
        repeated = 0.0
        again = shape = odd = 0
        if foreign:
            function, shop, odd = 0.0, 0.0, 1
            own = {w for w in dense if len(w) >= 4 or len(w) >= 2 and w[0] > "\u2e80"}
        else:
            known = list(filter(FUNCTION_WORDS.__contains__, words))
            function = len(known) / n
            if n > 12:  # lists join their keywords by the same one or two function words again and again
                function = min(function, 2 * len(set(known)) / n)
            shop = 0.0 if SHOP_WORDS.isdisjoint(words) else sum(map(SHOP_WORDS.__contains__, words)) / n
        linked = 0.0
        if "/" in line or "www." in line or "](" in line:
            linked = sum(len(m.group()) for m in _LINK.finditer(line)) / len(line)
        if not own.isdisjoint(words) and not (foreign and _STOP.search(line)):
            repeats = list(filter(own.__contains__, words))
            repeated = len(repeats) / n
        if repeated > 0.25:
            again = 0 if function >= 0.3 and not shop else 2 if max(Counter(repeats).values()) >= 3 else 1
        if function < 0.3:
            digits = _DIGIT.search(line)
            if "#" in line and len(_TAG.findall(line)) * 4 > n:
                shape = 3
            elif (digits and _GOODS.search(line) or "in stock" in line) and _PRODUCT.search(line):
                shape = 4
            elif _MARK.search(line) and len(_BETWEEN.findall(line)) >= 3:
                shape = 1
            elif (sum(map(line.count, ",،、，")) if foreign else line.count(",")) > (0.5 if foreign else 0.25) * n:
                shape = 2
            if not foreign and (not words or len(line) >= 40 and max(map(len, words)) >= 40 or (digits or not line.isascii()) and sum(map(str.isdigit, words)) > 0.5 * n):
                odd = 2
        ends = 0 if line.rstrip()[-1:] in _ENDS else 1 if n <= 5 else 2
        function = 4 if foreign else bisect_right(_FUNCTION_EDGES, function)
        shop = 4 if foreign else bisect_right(_SHOP_EDGES, shop)
        # By ``_SIZES``, written out.
        out.append((((((function * 3 + bisect_right(_LINK_EDGES, linked)) * 5 + shape) * 5 + shop) * 3 + again) * 3 + ends) * 3 + odd)
    return out


def _foreign(line: str) -> bool:
    """Whether most letters are of a script other than the Latin one."""
    beyond = sum(map(str.isalpha, "".join(_BEYOND.findall(line))))
    return beyond > 0 and beyond * 2 > sum(map(str.isalpha, line))


def _beliefs() -> list[np.ndarray]:
    """Starting belief about each feature in each state (rows: STATES)."""
    rows = [
        # share of function words: < .08, < .2, < .3, more, unknown
        [[2, 6, 14, 78, 5], [60, 25, 10, 5, 5], [50, 30, 12, 8, 5], [80, 12, 5, 3, 5], [70, 15, 10, 5, 5]],
        # share of characters in links: none, < .3, more
        [[95, 4, 1], [2, 8, 90], [96, 3, 1], [93, 5, 2], [97, 2, 1]],
        # shape: plain, separators, commas, hash tags, product
        [[95, 1, 3, 0.2, 0.8], [92, 4, 2, 1, 1], [40, 9, 25, 14, 12], [40, 58, 1, 0.5, 0.5], [70, 25, 3, 1, 1]],
        # share of shop words: none, < .1, < .25, more, unknown
        [[78, 19, 2.5, 0.5, 5], [40, 15, 20, 25, 5], [18, 10, 22, 50, 5], [60, 18, 14, 8, 5], [97, 1, 1, 1, 5]],
        # words of which the page consists: few, many, one again and again in the line
        [[88, 11, 1], [40, 45, 15], [15, 45, 40], [15, 45, 40], [70, 20, 10]],
        # end: of a sentence, short without, long without
        [[85, 6, 9], [30, 35, 35], [8, 32, 60], [3, 47, 50], [10, 40, 50]],
        # Latin words, other scripts, numbers or endless words
        [[89, 10, 1], [96, 2, 2], [96, 2, 2], [94, 2, 4], [15, 2, 83]],
    ]
    return [np.array(r, float) / np.array(r, float).sum(1, keepdims=True) for r in rows]


def _values(symbols: np.ndarray) -> list[np.ndarray]:
    """The value of each feature in each symbol."""
    out = []
    for k in reversed(_SIZES):
        symbols, value = np.divmod(symbols, k)
        out.append(value)
    return out[::-1]


_N_SYMBOLS = int(np.prod(_SIZES))
_VALUES = _values(np.arange(_N_SYMBOLS))


def _together(pages: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of pages of like lengths, longest first: their places, their symbols in a padded table (rows: lines), and how many of them reach each line."""
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    order = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        group = order[at : at + max(1, TOGETHER // longest)]
        there = lengths[group, None] > np.arange(longest)
        table = np.zeros(there.shape, np.int64)
        table[there] = np.concatenate([pages[i] for i in group])
        yield group.tolist(), np.ascontiguousarray(table.T), there.sum(0)
        at += len(group)


class LineModel:
    """Hidden Markov model whose emissions are products of the features' distributions."""

    def __init__(self) -> None:
        n = len(STATES)
        self.emit = _beliefs()
        self.start = np.array([0.86, 0.04, 0.05, 0.02, 0.03])
        self.move = np.full((n, n), 0.02)
        np.fill_diagonal(self.move, 0.92)

    def log_emissions(self) -> np.ndarray:
        """Row for each possible symbol: log probability in each state."""
        return sum(np.log(e[:, v].T) for e, v in zip(self.emit, _VALUES))

    def expected_counts(self, pages: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, moves and feature values over the pages, one after the other in one vector."""
        n = len(STATES)
        log_b = self.log_emissions()
        table = np.ascontiguousarray(np.exp(log_b - log_b.max(1, keepdims=True)).T)
        starts, moves, seen = np.zeros(n), np.zeros((n, n)), np.zeros((_N_SYMBOLS, n))
        for _, symbols, reach in _together(pages):
            # States first, then lines, then pages: one step works on whole rows of pages.
            b = table.take(symbols, axis=1)
            alpha, beta = np.zeros_like(b), np.ones_like(b)
            a = self.start[:, None] * b[:, 0]
            alpha[:, 0] = a / a.sum(0)
            for t in range(1, b.shape[1]):
                on = reach[t]
                a = (self.move.T @ alpha[:, t - 1, :on]) * b[:, t, :on]
                alpha[:, t, :on] = a / a.sum(0)
            for t in range(b.shape[1] - 2, -1, -1):
                on = reach[t + 1]
                x = self.move @ (b[:, t + 1, :on] * beta[:, t + 1, :on])
                beta[:, t, :on] = x / x.sum(0)
            # Lines that are no padding, and those of them that follow another (their places in the table without its first line).
            there = np.flatnonzero(np.arange(b.shape[2]) < reach[:, None])
            follows = there[b.shape[2] :] - b.shape[2]
            gamma = (alpha * beta).reshape(n, -1).take(there, axis=1)
            gamma /= gamma.sum(0)
            starts += gamma[:, : b.shape[2]].sum(1)
            flat = symbols.ravel()[there]
            for state in range(n):
                seen[:, state] += np.bincount(flat, gamma[state], _N_SYMBOLS)
            left = alpha[:, :-1].reshape(n, -1).take(follows, axis=1)
            right = (b[:, 1:] * beta[:, 1:]).reshape(n, -1).take(follows, axis=1)
            weight = 1.0 / ((self.move.T @ left) * right).sum(0)
            moves += self.move * ((left * weight) @ right.T)
        features = [np.stack([np.bincount(v, seen[:, state], k) for state in range(n)]) for v, k in zip(_VALUES, _SIZES)]
        return np.concatenate([starts, moves.ravel(), *[f.ravel() for f in features]])

    def updated(self, counts: np.ndarray) -> LineModel:
        """The model by the summed counts of all pages, with the starting beliefs as ``PRIOR_SHARE`` of them."""
        n = len(STATES)
        starts, moves = counts[:n], counts[n : n + n * n].reshape(n, n)
        new, at = LineModel(), n + n * n
        emit = []
        for belief, k in zip(new.emit, _SIZES):
            seen = counts[at : at + n * k].reshape(n, k)
            at += n * k
            seen = seen + belief * (PRIOR_SHARE * seen.sum() + 1e-9)
            emit.append(seen / seen.sum(1, keepdims=True))
        moves = moves + new.move * (PRIOR_SHARE * moves.sum() + 1e-9)
        starts = starts + new.start * (PRIOR_SHARE * starts.sum() + 1e-9)
        new.emit, new.move, new.start = emit, moves / moves.sum(1, keepdims=True), starts / starts.sum()
        return new

    def states(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each page's lines (Viterbi)."""
        out: list[np.ndarray] = [np.zeros(0, np.int8) for _ in pages]
        emit, move = np.ascontiguousarray(self.log_emissions().T), np.log(self.move)[:, :, None]
        for group, symbols, reach in _together(pages):
            table = emit.take(symbols, axis=1)
            score = np.log(self.start)[:, None] + table[:, 0]
            back = np.zeros(table.shape, np.int8)
            for t in range(1, table.shape[1]):
                on = reach[t]
                best, origin = score[0, :on] + move[0], back[:, t, :on]
                for state in range(1, len(STATES)):
                    step = score[state, :on] + move[state]
                    np.copyto(origin, np.int8(state), where=step > best)
                    np.maximum(best, step, out=best)
                score[:, :on] = best + table[:, t, :on]
            state = np.zeros(symbols.shape, np.int8)
            last = score.argmax(0)
            rows = np.arange(len(group))
            for t in range(table.shape[1] - 1, -1, -1):
                on = reach[t]
                state[t, :on] = last[:on]
                last[:on] = back[last[:on], t, rows[:on]]
            state = np.ascontiguousarray(state.T)
            for row, i in enumerate(group):
                out[i] = state[row, : len(pages[i])]
        return out


def spam_shares(model: LineModel, pages: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Share of each page's visible characters in lines that are no prose (0 for a blank page)."""
    spam = np.isin(np.arange(len(STATES)), SPAM_STATES)
    return np.array([n[spam[s]].sum() / max(n.sum(), 1) if len(n) else 0.0 for s, n in zip(model.states(pages), sizes)])


def spam_share(model: LineModel, text: str | None) -> float:
    """``spam_shares`` of one text (0 for a null or blank one)."""
    lines = lines_of(text or "")
    return float(spam_shares(model, [np.array(symbols_of(lines), np.int64)], [np.array([len(x.strip()) for x in lines], np.int64)])[0])


_LINES = "symbols array<smallint>, sizes array<int>"


def line_symbols(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, symbols, sizes`` of the lines of every page that has some."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, symbols, sizes = [], [], []
            for i, text in enumerate(batch.column(1)):
                if lines := lines_of(text.as_py() or ""):
                    ids.append(i)
                    symbols.append(symbols_of(lines))
                    sizes.append([len(line.strip()) for line in lines])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(symbols, pa.list_(pa.int16())), pa.array(sizes, pa.list_(pa.int32()))], [id_col, "symbols", "sizes"])

    return in_arrow(docs.select(id_col, text_col), describe, f"{id_col} {id_type}, {_LINES}")


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def fit_line_model(lines: DataFrame, rounds: int = FIT_ROUNDS) -> LineModel:
    """The line model, fitted on all pages of ``lines(symbols)``."""
    model = LineModel()
    for _ in range(rounds):
        sent = lines.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + sent.value.expected_counts(_lists(batch.column(0)))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "n"])

        # The counts are summed before they reach the driver: one number for each, whatever the number of tasks.
        found = in_arrow(lines.select("symbols"), count, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
        if not found:
            break
        model = model.updated(np.array([r.n for r in found]))
    return model


def page_labels(lines: DataFrame, model: LineModel, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, spam_share`` of every page of ``lines(id_col, symbols, sizes)``."""
    sent = lines.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = spam_shares(sent.value, _lists(batch.column(1)), _lists(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], [id_col, "spam_share"])

    return in_arrow(lines.select(id_col, "symbols", "sizes"), label, f"{id_col} {lines.schema[id_col].dataType.simpleString()}, spam_share double")


def spam_pages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col`` of the pages more than half of which is link lists, tag lists, keywords or menus.

    Null, empty and blank texts are never flagged; repeated rows of a page are flagged each; an empty table gives
    no rows; other columns are not read.
    """
    lines = materialize(line_symbols(docs, id_col=id_col, text_col=text_col), "lines")
    return page_labels(lines, fit_line_model(lines), id_col=id_col).filter(F.col("spam_share") > threshold).select(id_col)
