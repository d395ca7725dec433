"""Toxicity of texts whose words may be disguised: a noisy channel restores them, then restored words are scored.

Channel: a sign may stand for a letter, signs and blanks may be thrown between letters, letters may be repeated, and
accents, wide forms and letters of other scripts may stand for the letters they look like. A token that shows any of
this becomes a lattice of what its characters may have been, and the path that a character language model and the
channel's costs like best is what was meant; parts between separators are decoded by themselves, too. Letters that look
like others are read either way: a text's tokens as they are, and tokens of such letters once more as what they look
like. A token whose one sign of disguise is a letter twice has two paths, compared for all such tokens at once. Other
tokens have one path, themselves. The language model counts four characters at a time over the whole corpus.

Score: the terms of a restored text are its words and their first letters, as 64-bit hashes. A first pass over labelled
texts counts in a table of fixed size how often terms come in toxic and in clean ones. A second gives each toxic text's
label to its most telling term, and to others as telling and common, so that words which merely stand near get nothing. A text's score is that of
its most telling term. The labelled texts may be a bounded sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uniform import lowest
from .byte_words import mix, random_words, text_slices, words_of
from .durable import durable, read_table, with_columns
from .language_id import fold

#: Labels that term weights are learned from at most.
SAMPLE_ROWS = 40_000
TERMS = 1 << 20
#: First bytes of a word that are terms besides the whole word.
PREFIXES = (4, 5, 6, 7)
REJECT = 0.7
#: A term that at least COMMON toxic texts have shares a text's label with those that are as telling, within NEAR, and
#: at least half as common.
NEAR, COMMON = 0.02, 8

#: What a sign may stand for (fixed values of the channel).
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs in nats: a sign for a letter, a sign thrown in, a blank thrown in, a letter twice, more often, a sign that means itself.
SIGN, THROWN, SPACED, DOUBLED, REPEATED, ITSELF = 1.0, 1.0, 0.3, 2.5, 0.2, 5.0

#: Letters that look like Latin ones (fixed values of the channel); accents and wide forms fold by Unicode's own tables.
LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
_LOOKS, _FOLDED, _MARKS = re.compile(f"[{''.join(LOOKS_LIKE)}]"), str.maketrans(LOOKS_LIKE), re.compile("[\u0300-\u036f]+")
#: Tokens without such letters that are longer than one character: what looks like nothing else is not read again.
_AS_IT_IS = re.compile(r"(?<![^ \t-\r])[!-~]{2,}(?![^ \t-\r])")

#: Signs that join words or letters to one token and stand for no letter.
_SEPARATORS = re.compile(r"[-._/\\,;:~*#=&?%'\"<>\[\]{})^` ]+")

_END, _OTHER, _SYMBOLS = 0, 27, 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = _OTHER
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for s in STANDS_FOR for b in s.encode() if b < 128]] = True
_SALT = random_words(len(PREFIXES) + 1, 12)


def _contexts(code: np.ndarray) -> np.ndarray:
    """Number of (three characters before, character) at each place; what lies before a word's start does not show."""
    c2 = np.concatenate([[0], code[:-1]])
    c1 = np.where(c2 == 0, 0, np.concatenate([[0, 0], code[:-2]])[: len(code)])
    c0 = np.where(c1 == 0, 0, np.concatenate([[0, 0, 0], code[:-3]])[: len(code)])
    return ((c0 * _SYMBOLS + c1) * _SYMBOLS + c2) * _SYMBOLS + code


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over every whole text: how often each of at most 28**4 grams of four characters occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**4, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                if len(data):
                    code = _CODE[data]
                    gram = _contexts(code)
                    total += np.bincount(gram[(code > 0) | (np.concatenate([[0], code[:-1]]) > 0)], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["gram", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """-log P(character | three before), interpolated with shorter contexts; the counts are at most 28**4 rows."""
    table = counts.toArrow()
    n = np.zeros(_SYMBOLS**4)
    n[table["gram"].to_numpy()] = table["n"].to_numpy()
    n = n.reshape((_SYMBOLS,) * 4)
    prob = np.full(_SYMBOLS, 1 / _SYMBOLS)
    for order in range(4):
        c = n.sum(axis=tuple(range(3 - order)))
        prob = (c + 5 * prob) / (c.sum(axis=-1, keepdims=True) + 5)
    return -np.log(prob).astype(np.float32).reshape(-1, _SYMBOLS)


class Restorer:
    """Finds what was meant by a disguised token."""

    #: Tokens remembered, and the longest of these; longer ones are decoded each time.
    REMEMBERED, LONGEST = 200_000, 60
    #: After so many characters what all paths share is written out, so that long tokens and runs take no more memory.
    STRETCH = 1024

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = cost, {}

    def words(self, token: bytes) -> list[bytes]:
        """The restored words of a token (lower case), or of several one-letter tokens with blanks between them."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            text = token.decode("utf-8", "replace").lower().strip("\"'#%&*.,;:?()[]{}<>-_=/\\~^`")
            for sign in "!$@+|":
                if text.endswith(sign * 2) or text.startswith(sign * 2):
                    text = text.strip(sign)
            restored = " ".join([self.decode(text), *(self.decode(part) for part in _joined(text))])
            found = [w.encode() for w in "".join(c if c.isalpha() else " " for c in restored).split()]
            if len(token) <= self.LONGEST:
                self.known[token] = found
        return found

    def decode(self, text: str) -> str:
        """Best path by Viterbi; a state is the three characters written last, with the letter written last."""
        cost, done = self.cost, ""
        states: dict[tuple[int, str], tuple[float, tuple]] = {(0, ""): (0.0, ())}
        for at, char in enumerate(text):
            alpha = char.isalpha()
            options = [(char, 0.0)] if alpha else [(x, SIGN) for x in STANDS_FOR.get(char, "")]
            inside = 0 < at < len(text) - 1
            again = REPEATED if at > 1 and char == text[at - 1] == text[at - 2] or text[at + 1 : at + 2] == char == text[at - 1 : at] else DOUBLED
            new: dict[tuple[int, str], tuple[float, tuple]] = {}

            def put(key, value, path, new=new):
                if key not in new or value < new[key][0]:
                    new[key] = value, path

            for (context, last), (so_far, path) in states.items():
                for letter, price in options:
                    code = ord(letter) - 96 if "a" <= letter <= "z" else _OTHER
                    put(((context * _SYMBOLS + code) % _SYMBOLS**3, letter), so_far + price + float(cost[context, code]), (path, letter))
                    if letter == last and at:
                        put((context, last), so_far + price + again, path)
                if not alpha:
                    if inside:
                        put((context, last), so_far + (SPACED if char == " " else THROWN), path)
                    end = float(cost[context, _END]) if context else 0.0
                    put((0, ""), so_far + end + (0.0 if char == " " else ITSELF), (path, char))
            states = new
            if (at + 1) % self.STRETCH == 0:
                written = {key: _written(path) for key, (_, path) in states.items()}
                shared = commonprefix(list(written.values()))
                done += shared
                states = {key: (value, reduce(lambda path, letter: (path, letter), written[key][len(shared) :], ())) for key, (value, _) in states.items()}
        path = min(states.items(), key=lambda s: (s[1][0] + float(cost[s[0][0], _END]), s[0][1]))[1][1]
        return done + _written(path)


def _joined(text: str) -> list[str]:
    """What separators may have joined, besides the text itself: parts of three characters or more, and runs of three one-character parts or more as if blanks lay between."""
    out = []
    for single, parts in groupby(filter(None, _SEPARATORS.split(text)), lambda part: len(part) == 1):
        parts = list(parts)
        if not single:
            out += [part for part in parts if 3 <= len(part) < len(text)]
        elif len(parts) >= 3 and " " not in text:
            out.append(" ".join(parts))
    return out


def _written(path: tuple) -> str:
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _disguised(data: np.ndarray, words) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Which tokens show a disguise, runs [first, last] of at least three one-character tokens of a text, and which tokens show only one letter twice."""
    code = _CODE[data]
    letter = code > 0

    def per_word(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[words.end] - sums[words.start]

    letters, size = per_word(letter), words.end - words.start
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (letter | _SIGNS[data])[1:]
    thrice = np.zeros(len(data), bool)
    thrice[1:] = same[1:] & same[:-1]
    doubled = per_word(same & (code < _OTHER))  # the halves of a letter of two bytes are no letter twice
    repeated = (per_word(thrice) > 0) | (doubled > 1)
    signs = per_word(_SIGNS[data] | ((~letter) & (data > 32)))
    # punctuation around a word is no disguise: signs must lie inside, or be ones that stand for letters
    first, last = data[words.start], data[words.end - 1] if len(words.end) else data[:0]
    edge = (~_letter_or_sign(first)).astype(int) + (~_letter_or_sign(last)).astype(int)
    show = (letters > 0) & (repeated | (signs > edge))
    single = (size == 1) & (letter | _SIGNS[data])[words.start] if len(size) else np.zeros(0, bool)
    change = np.flatnonzero(np.diff(np.concatenate([[0], (single * (words.text + 1))])))
    edges = [*change.tolist(), len(single)]
    runs = [(a, b - 1) for a, b in zip(edges, edges[1:]) if b - a >= 3 and single[a]]
    return show, runs, ~show & (doubled == 1) & (letters == size)


def _once(data: np.ndarray, words, which: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Tokens of letters with one letter twice that are likelier with it once: their numbers, and how they then read."""
    which = np.flatnonzero(which)
    size = words.end[which] - words.start[which] + 1  # and a blank
    start = np.cumsum(size) - size
    stream = np.full(int(size.sum()), 32, np.uint8)
    inside = np.ones(len(stream), bool)
    inside[start + size - 1] = False
    stream[inside] = data[np.repeat(words.start[which] - start, size)[inside] + np.flatnonzero(inside)]
    twice = np.zeros(len(stream), bool)
    twice[1:] = (stream[1:] == stream[:-1]) & (_CODE[stream] > 0)[1:] & (_CODE[stream] < _OTHER)[1:]
    flat = cost.reshape(-1)

    def price(bytes_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flat[_contexts(_CODE[bytes_])].astype(float), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)

    likelier = np.flatnonzero(price(stream[~twice], size - 1) + DOUBLED < price(stream, size))
    kept = [stream[start[k] : start[k] + size[k] - 1][~twice[start[k] : start[k] + size[k] - 1]].tobytes() for k in likelier]
    return which[likelier], kept


def _letter_or_sign(x: np.ndarray) -> np.ndarray:
    return (_CODE[x] > 0) | _SIGNS[x]


def terms_of(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit term) of every word of the restored texts: the whole word and each of its prefixes."""
    text, term = _terms(data, offsets, restorer)
    bounds = np.concatenate([[0], np.cumsum(data > 127)])
    others = np.flatnonzero(np.diff(bounds[offsets]))
    if not len(others):
        return text, term
    folded = [folded_text(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")).encode() for k in others]
    more, again = _terms(np.frombuffer(b"".join(folded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in folded])]), restorer)
    return np.concatenate([text, others[more]]), np.concatenate([term, again])


def folded_text(text: str) -> str:
    """The tokens of a text that have letters which look like others, as those, and its one-character tokens; others become ``--``."""
    text = _MARKS.sub("", unicodedata.normalize("NFKD", _AS_IT_IS.sub("--", text).lower()))
    return text.translate(_FOLDED) if _LOOKS.search(text) else text


def _terms(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    tokens = words_of(data, offsets)
    show, runs, twice = _disguised(tokens.data, tokens)
    raw = tokens.data
    owner, extra = [], []
    for i in np.flatnonzero(show).tolist():
        found = restorer.words(raw[tokens.start[i] : tokens.end[i]].tobytes())
        owner += [tokens.text[i]] * len(found)
        extra += found
    for a, b in runs:
        found = restorer.words(b" ".join(raw[tokens.start[k] : tokens.end[k]].tobytes() for k in range(a, b + 1)))
        owner += [tokens.text[a]] * len(found)
        extra += found
    which, once = _once(raw, tokens, twice, restorer.cost)
    owner += tokens.text[which].tolist()
    extra += once
    show[which] = True
    # the letters of the other tokens
    letter = _CODE[raw] > 0
    hide = np.zeros(len(raw) + 1, np.int64)
    np.add.at(hide, tokens.start[show], 1)
    np.add.at(hide, tokens.end[show], -1)
    plain = np.where(letter & (np.cumsum(hide)[:-1] == 0), raw, np.uint8(32))
    text_a, term_a = _hashed(words_of(plain, offsets))
    if not extra:
        return text_a, term_a
    joined = np.frombuffer(b" ".join(extra), np.uint8)
    own = words_of(joined, np.array([0, len(joined)]))
    assert len(own.start) == len(extra)
    own.text = np.array(owner, np.int64)
    text_b, term_b = _hashed(own)
    return np.concatenate([text_a, text_b]), np.concatenate([term_a, term_b])


def _hashed(words) -> tuple[np.ndarray, np.ndarray]:
    size = words.end - words.start
    keep = size >= 3
    start, end, text, size = words.start[keep], words.end[keep], words.text[keep], size[keep]
    texts, terms = [text], [mix(words.hash_of(start, end) ^ _SALT[0])]
    for k, n in enumerate(PREFIXES, 1):
        longer = size > n
        texts.append(text[longer])
        terms.append(mix(words.hash_of(start[longer], start[longer] + n) ^ _SALT[k]))
    return np.concatenate(texts), np.concatenate(terms)


def _bucket(term: np.ndarray) -> np.ndarray:
    return (term % np.uint64(TERMS)).astype(np.int64)


def _labelled_terms(batch: pa.RecordBatch, restorer: Restorer) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    labels = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in text_slices(batch.column(1)):
        text, term = terms_of(data, offsets, restorer)
        order = np.lexsort((term, text))
        text, term = text[order], term[order]
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
        yield labels[a:b], text[fresh], term[fresh]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from all texts (characters) and from labelled ones (terms). ``labels``: doc_id, toxic (0 or 1; others are skipped).

    Without labelled texts every score is 0. At most ``sample_rows`` labels are learned from, those of the lowest hash of
    doc_id; a doc_id with both labels has its texts learned under either. What is broadcast is of fixed size: 2.5 MB of
    character costs, TERMS counts of 8 bytes, and 12 bytes a term that some toxic text was credited to.
    """
    spark = docs.sparkSession
    cost = character_model(character_counts(docs, text))
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    marks = marks.withColumn("h", F.xxhash64(F.lit("toxic sample"), "doc_id"))
    known = marks.count()
    if known > sample_rows:  # rows beyond a threshold with room to spare need not be sorted
        marks = marks.where(F.col("h") <= lowest(known, sample_rows)).orderBy("h", "doc_id", "toxic").limit(sample_rows)
    marks = F.broadcast(durable(marks.drop("h"), "marks"))  # at most sample_rows rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(marks, "doc_id")
    rows = rows.dropDuplicates(["text", "toxic"]).select("toxic", "text")
    rows = durable(rows, "labelled")
    shared = spark.sparkContext.broadcast(cost)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total = Restorer(shared.value), np.zeros((2, TERMS), np.int64)
        for batch in batches:
            for label, owner, term in _labelled_terms(batch, restorer):
                for k in (0, 1):
                    total[k] += np.bincount(_bucket(term[label[owner] == k]), minlength=TERMS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["term", "clean", "toxic"])

    counted = rows.mapInArrow(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    clean, toxic = np.zeros(TERMS), np.zeros(TERMS)
    clean[counted["term"].to_numpy()], toxic[counted["term"].to_numpy()] = counted["clean"].to_numpy(), counted["toxic"].to_numpy()
    known = spark.sparkContext.broadcast((((toxic + 0.1) / (toxic + clean + 1)).astype(np.float32), toxic.astype(np.int32)))

    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, (telling, support) = Restorer(shared.value), known.value
        for batch in batches:
            found: list[int] = []
            for label, owner, term in _labelled_terms(batch, restorer):
                mine = label[owner] == 1
                owner, term = owner[mine], term[mine]
                order = np.lexsort((term, -telling[_bucket(term)], owner))
                owner, term = owner[order], term[order]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                at = _bucket(term)
                best = at[np.repeat(first, np.diff(np.append(first, len(term))))]
                equal = (telling[at] >= telling[best] - NEAR) & (2 * support[at] >= support[best]) & (support[best] >= COMMON)
                equal[first] = True
                found += term[equal].view(np.int64).tolist()
            yield pa.record_batch([pa.array(found, pa.int64())], ["term"])

    credits = rows.mapInArrow(credit, "term long").groupBy("term").agg(F.count("*").alias("n")).toArrow()
    terms, own = credits["term"].to_numpy().view(np.uint64), credits["n"].to_numpy()
    order = np.argsort(terms)
    terms, own = terms[order], own[order]
    weights = ((own + 0.02) / (own + clean[_bucket(terms)] + 1)).astype(np.float32)
    held = np.zeros(TERMS, bool)  # most terms of a text are no such term: one look at a table tells
    held[_bucket(terms)] = True
    return {"cost": shared, "weight": spark.sparkContext.broadcast((terms, weights, held))}


def _weights_of(term: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Learned weight of each term, 0 for others."""
    terms, weights, held = model
    out = np.zeros(len(term), np.float32)
    some = np.flatnonzero(held[_bucket(term)])
    if len(some):
        at = np.minimum(np.searchsorted(terms, term[some]), len(terms) - 1)
        out[some] = np.where(terms[at] == term[some], weights[at], 0)
    return out


def scored(docs: DataFrame, model: dict, text: str = "text") -> tuple[DataFrame, str]:
    """Every row of ``docs`` with the score of its own text, 0 to 1, and the name of that column.

    Null, empty and wordless texts have 0; repeated rows and rows with a null doc_id are scored each.
    """
    cost, weight = model["cost"], model["weight"]

    def of(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        restorer = Restorer(cost.value)
        for a, b, data, offsets in text_slices(texts):
            owner, term = terms_of(data, offsets, restorer)
            best = np.zeros(b - a)
            np.maximum.at(best, owner, _weights_of(term, weight.value))
            yield a, b, [pa.array(np.minimum(best, 1.0))]

    rows, names = with_columns(docs, text, [T.StructField("score", T.DoubleType())], of)
    return rows, names[0]


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, as ``scored`` has it."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), model)[0].select("doc_id", "score")


def learning_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(fold("doc_id", 3) != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity, learned from the labels outside the held-out third."""
    docs = read_table(spark, sf_dir, "documents")
    done = score(docs, train(docs, learning_labels(read_table(spark, sf_dir, "labels"))))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
