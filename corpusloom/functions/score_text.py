"""Column expressions on symbol texts: lines by newline, spines by tab, chords by space, ``·`` and ``@`` inside symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text format: a line with one of these as a whole field carries no notes.
CONTROL_FIELDS = ("*tremolo", "*staff2", "*staff1", "*Xped", "*tremolo", "*ped", "*Xtuplet", "*tuplet", "*Xtremolo", "*cue", "*Xcue", "*rscale:1/2", "*rscale:1", "*kcancel", "*below")
# Lines that a continuation repeats need not restate these.
RESTATED = ("*clef", "*k", "*M", "*met")
LINE, SPINE, CHORD = "<b>", "<t>", "<s>"
BEGIN, END = "<bos>", "<eos>"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once: an expression that a lambda names is computed anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clean_score_lines(text: Column) -> Column:
    """Drop lines that hold a control field, and lines whose fields are all ``*``; blank lines stay. Null stays null."""

    def keep(line: Column) -> Column:
        controls = F.array(*[F.lit(x) for x in sorted(set(CONTROL_FIELDS))])
        return once(F.split(line, "\t", -1), lambda fields: ~F.arrays_overlap(fields, controls) & ~F.forall(fields, lambda x: x == "*"))

    return F.array_join(F.filter(_lines(text), keep), "\n")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_MARKS = [(" ", f" {CHORD} "), ("\t", f" {SPINE} "), ("\n", f" {LINE} ")]
_SLASHES = [(" /", ""), (" \\", ""), ("·/", ""), ("·\\", "")]
_MODES = {"kern": [("·", ""), ("@", "")], "ekern": [("·", " "), ("@", "")], "bekern": [("·", " "), ("@", " ")]}


def strip_measure_numbers(text: Column) -> Column:
    """Remove the digits behind ``=``."""
    return F.regexp_replace(text, r"(?<==)\d+", "")


def tokenize_score(text: Column, mode: str) -> Column:
    """Tokens of a cleaned text in ``kern``, ``ekern`` or ``bekern``: the header's four and the last one are left out."""
    tokens = F.split(_replaced(text, _MARKS + _SLASHES + _MODES[mode]), " ", -1)
    return once(tokens, lambda t: F.transform(F.slice(t, F.lit(5), F.greatest(F.size(t) - 5, F.lit(0))), strip_measure_numbers))


def tokenize_score_source(text: Column) -> Column:
    """Marked text of a cleaned one, for composing: slashes and the last token stay, the mode is applied later."""
    tokens = F.split(_replaced(text, _MARKS), " ", -1)
    return once(tokens, lambda t: F.array_join(F.transform(F.slice(t, F.lit(5), F.greatest(F.size(t) - 4, F.lit(0))), strip_measure_numbers), " "))


def render_mode(tokens: Column, mode: str) -> Column:
    """A composed piece's tokens in a mode, empty ones dropped."""
    marks = [(x, f" {x} ") for x in (CHORD, LINE, SPINE)]
    return F.filter(F.split(_replaced(F.array_join(tokens, ""), marks + _MODES[mode]), " ", -1), lambda x: x != "")


def add_sequence_markers(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), tokens, F.array(F.lit(END)))


def drop_empty_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def truth_tokens(tokens: Column, keep_eos: bool = False) -> Column:
    """Tokens to hold a prediction against: without the end mark, which predictions lack, unless ``keep_eos``."""
    return tokens if keep_eos else F.filter(tokens, lambda x: x != END)


def detokenize(tokens: Column, render: bool = False) -> Column:
    """Text of tokens; ``render`` puts the two-spine header before it and drops ``@`` and ``·``."""
    text = _replaced(F.array_join(tokens, ""), [(SPINE, "\t"), (LINE, "\n"), (CHORD, " ")])
    return F.concat(F.lit("**ekern_1.0\t**ekern_1.0\n"), _replaced(text, [("@", ""), ("·", "")])) if render else text


def tokenize_aligned(text: Column, blank: str = "\t") -> Column:
    """Tokens between newlines and ``blank``; empty ones stay, an empty text is one empty token."""
    return F.split(F.translate(text, "\n", blank), blank, -1)


def split_symbols(text: Column) -> Column:
    """Tokens between runs of white space; an empty text has none."""
    return F.filter(F.split(text, r"[ \t\n\r\x0b\f]+", -1), lambda x: x != "")


def error_rate_views(text: Column, strict: bool = False) -> dict[str, Column]:
    """Token views for symbol, line and character error rates.

    The character view explodes the line and spine marks and leaves other tokens whole; ``strict`` explodes those and
    leaves the marks whole.
    """
    ser = F.split(_replaced(text, [("\n", f" {LINE} "), ("\t", f" {SPINE} ")]), " ", -1)
    ler = F.transform(_lines(text), lambda x: F.replace(x, F.lit("\t"), F.lit(f" {SPINE} ")))

    def chars(x: Column) -> Column:
        mark = x.isin(LINE, SPINE)
        # one element a character: empty regex, the empty tail dropped
        each = F.filter(F.split(x, ""), lambda c: c != "")
        return F.when(~mark if strict else mark, each).otherwise(F.array(x))

    return {"ser": ser, "ler": ler, "cer": F.flatten(F.transform(ser, chars))}


def split_columns_text(text: Column) -> Column:
    """struct(second, first, joined) of the lines behind the first with two fields or more, right-stripped; joined: the second ones."""
    lines = F.transform(_lines(text), lambda x: F.split(F.regexp_replace(x, r"\s+$", ""), "\t", -1))
    lines = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.size(x) >= 2)
    first, second = F.transform(lines, lambda x: x[0]), F.transform(lines, lambda x: x[1])
    return F.struct(second.alias("second"), first.alias("first"), F.array_join(second, " ").alias("joined"))


def split_columns_levels(text: Column) -> Column:
    """struct(lines, flat). Per line: first field, ``<t>``, the characters of the second up to its first ``<`` and, if it
    has one, ``<b>``; a line without a tab gives an empty list. flat: all lines' elements without the ``<b>``."""

    none = F.array().cast("array<string>")

    def one(fields: Column) -> Column:
        second = fields[1]
        chars = F.filter(F.split(F.substring_index(second, "<", 1), ""), lambda c: c != "")
        return F.when(F.size(fields) >= 2, F.concat(F.array(fields[0], F.lit(SPINE)), chars)).otherwise(none)

    def closed(fields: Column) -> Column:
        return F.concat(one(fields), F.when((F.size(fields) >= 2) & fields[1].contains("<"), F.array(F.lit(LINE))).otherwise(none))

    fields = F.transform(_lines(text), lambda x: F.split(x, "\t", -1))
    return F.struct(F.transform(fields, closed).alias("lines"), F.flatten(F.transform(fields, one)).alias("flat"))


def two_spines(text: Column) -> Column:
    """Exactly two ``*-``."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("*-"), F.lit("")))) / 2 == 2


def meter_markers(text: Column) -> Column:
    """The first ``*M...`` of each line that has one, to be exploded; a text may give several."""
    return F.transform(F.filter(_lines(text), lambda x: x.contains("*M")), lambda x: F.regexp_extract(x, r"\*M\S*", 0))


def filter_continuation(tokens: Column, cut: bool) -> Column:
    """Tokens of a piece that continues another: up to its first barline it does not restate clef, key and meter (without a barline: nowhere).

    ``cut`` drops the last five tokens first. Works on lines (tokens between ``<b>``); empty tokens go.
    """
    body = once(tokens, lambda t: F.slice(t, F.lit(1), F.greatest(F.size(t) - 5, F.lit(0)))) if cut else tokens
    lines = F.split(F.array_join(body, " "), f" {LINE} ", -1)

    def restates(line: Column) -> Column:
        out = F.lit(False)
        for x in RESTATED:
            out = out | line.contains(x)
        return out

    def kept(lines: Column) -> Column:
        barline = F.coalesce(F.array_position(F.transform(lines, lambda x: x.contains("=").cast("int")), 1), F.lit(0))
        return once(barline, lambda bar: F.filter(lines, lambda x, i: ~(((bar == 0) | (i < bar)) & restates(x))))

    return F.filter(F.split(F.array_join(once(lines, kept), f" {LINE} "), " ", -1), lambda x: x != "")


def dedupe_line_breaks(tokens: Column) -> Column:
    """Drop a line mark at the start or directly behind another."""
    return once(tokens, lambda t: F.filter(t, lambda x, i: ~((x == LINE) & ((i == 0) | (F.element_at(t, F.greatest(i, F.lit(1))) == LINE)))))
