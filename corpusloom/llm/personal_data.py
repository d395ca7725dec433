"""Personal data by weak supervision, with DataFrame functions only.

Exact patterns give the base spans, which always stay. Matches that fail an exact pattern's check, and matches of looser
patterns in the gaps between exact ones, are candidates beside them. Six labelers (pattern, shape, gazetteer, context,
edges, variety) vote yes, no or nothing on every candidate and base span. Expectation-maximisation over the counts of
vote patterns estimates how often each labeler votes what on true and on false spans of a kind (Dawid and Skene, 1979);
its posteriors are soft labels for a logistic regression on votes and forms, which decides which candidates are added.

Texts are read once, in a pass without a shuffle; what is counted afterwards are vote patterns, whose number is bounded
by the labelers. Spans of one kind never overlap, as a gap holds no part of an exact match.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, read_table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "shape", "gazetteer", "context", "edges", "variety")
VOTES = (-1, 0, 1)
#: Forms of a candidate that no labeler sees: how long it is, and whether it holds a bracket or a blank.
FORMS = ("long", "bracketed", "spaced")
#: A candidate is added at this probability.
LEAST = 0.5
#: Rounds of expectation-maximisation: the steps shrink geometrically, and a round is a few thousand sums.
ROUNDS = 60

# Possessive quantifiers, and starts only where a run of the first class starts: the leftmost matches of the plain
# patterns, in linear time and without recursion on runs of any length.
_LOCAL = "A-Za-z0-9._%+-"
_STARTS = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++"
EXACT = {
    "email": rf"{_STARTS}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?"
_IP_DOT = r"(?:\.|\[\.\]|\(\.\))"
LOOSE = {
    "email": rf"{_STARTS}(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++",
    "ip": rf"[0-9](?<![0-9]{{2}})[0-9]*+(?:{_IP_DOT}[0-9]++){{3}}+",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20.-][0-9])(?:[\x20.-]?[0-9]){12,18}+(?![\x20.-]?[0-9])",
    "phone": r"[(0-9](?<![0-9A-Za-z.+(-].)(?:(?<=\()(?:00)?[0-9]{1,3}\)?[\x20.-]|(?<=[0-9])[0-9]{0,4}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
#: What a text with a match of the pattern holds in any case, found faster.
_HINT = {
    "email": r"[\[({]\x20?(?:at|AT|@|dot|DOT|\.)\x20?[\])}]",
    "ip": rf"[0-9]{_IP_DOT}[0-9]+{_IP_DOT}[0-9]",
    "card": r"[0-9](?:[\x20.-]?[0-9]){12}",
    "phone": r"[0-9]{2}\)?[\x20.-][0-9]{3}",
}

# fixed values: word lists of the gazetteer and context labelers
TOP_DOMAINS = "com org net edu gov mil int info biz io co ai app dev me de fr es it uk us ca au nl be ch at pl pt se no fi dk ie eu ru cn jp in br mx ar".split()
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421 852 966 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64[4-9]|62)"
CONTEXT = {
    "email": "email e-mail mail contact write courriel correo kontakt",
    "ip": "ip address host server client addr login adresse",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta",
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon téléphone teléfono",
}
AGAINST = "version v isbn issn order invoice sku id hash token page chapter section ticket serial"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_OWN_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once, however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _luhn(digits: str) -> str:
    """The check sum of up to 19 digits."""
    twice = f"transform(sequence(1, 19), k -> int(substring(lpad({digits}, 19, '0'), k, 1)) * (2 - k % 2))"
    return f"aggregate({twice}, 0, (a, d) -> a + d - if(d > 9, 9, 0)) % 10 = 0"


#: The check of an exact match x.
_PASSES = {
    "email": "true",
    "ip": rf"x.value RLIKE r'^0*{_OCTET}(?:\.0*{_OCTET}){{3}}$'",
    "card": _luhn("x.digits"),
    "phone": "length(x.digits) BETWEEN 10 AND 15",
}


def _vote(yes: str, no: str = "true") -> str:
    """1, -1 or 0; without ``no`` whatever is not yes is no."""
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def _votes(kind: str, exact: bool) -> list[str]:
    """One vote a labeler on a match x with the fields value, plain, digits, before, after."""
    shape = {
        "email": r"x.plain RLIKE r'^[^@]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+(?<!-))?\.)+[A-Za-z]{2,}$'",
        "ip": rf"x.plain RLIKE r'^{_OWN_OCTET}(?:\.{_OWN_OCTET}){{3}}$'",
        "card": _luhn("x.digits"),
        "phone": "length(x.digits) BETWEEN 10 AND 15",
    }[kind]
    known = {
        "email": _vote(f"lower(substring_index(x.plain, '.', -1)) IN ({', '.join(map(repr, TOP_DOMAINS))})"),
        "ip": _vote(rf"x.plain RLIKE r'^(?!0\.|127\.|22[4-9]\.|2[3-9][0-9]\.){_OWN_OCTET}\.'"),
        "card": _vote(f"x.digits RLIKE r'{ISSUERS}'"),
        "phone": _vote(f"startswith(x.value, '+') AND x.digits RLIKE r'^(?:{'|'.join(CALLING_CODES)})'", "startswith(x.value, '+')"),
    }[kind]
    near = lambda words: rf"x.before RLIKE r'(?iu)(?:^|[^\p{{L}}0-9])(?:{'|'.join(words.split())})[^\p{{L}}0-9]{{0,8}}$'"
    glued = r"(x.before RLIKE r'[\p{L}0-9_]$' OR x.after RLIKE r'^[\p{L}0-9_]')"
    varied = "0" if kind == "email" else _vote(r"NOT x.digits RLIKE r'^(.)\1*+$'")
    return [_vote(_PASSES[kind]) if exact else "0", _vote(shape), known, _vote(near(CONTEXT[kind]), near(AGAINST)), _vote(f"NOT {glued}"), varied]


#: Numbers that one running sum adds up directly.
_CHUNK = 256


def _running(sizes: str) -> str:
    """The sum of the elements before each element, by chunks: none is added more than ``_CHUNK`` times."""
    total = lambda x: f"aggregate({x}, 0L, (a, b) -> a + b)"
    chunks = f"transform(sequence(0, int(size(z) div {_CHUNK})), c -> {total(f'slice(z, c * {_CHUNK} + 1, {_CHUNK})')})"
    starts = f"transform(y, (e, c) -> {total('slice(y, 1, c)')})"
    summed = f"transform(z, (e, i) -> get(y, int(i div {_CHUNK})) + {total(f'slice(z, int(i div {_CHUNK}) * {_CHUNK} + 1, i % {_CHUNK})')})"
    return _let("z", sizes, _let("y", _let("y", chunks, starts), summed))


_FIELDS = ("kind", "start", "end", "base", *LABELERS, *FORMS)
_SPAN = f"array<struct<kind:int,start:bigint,end:bigint,base:boolean,{','.join(f'{n}:int' for n in (*LABELERS, *FORMS))}>>"


def _found(text: str, pattern: str, use: str) -> str:
    """``use`` of m: the matches ``hits``, the ``gaps`` around them (one more), the matches' ``starts`` in code points."""
    steps = _running("transform(m.hits, (h, i) -> bigint(length(get(m.gaps, i)) + length(h)))")
    starts = f"transform({steps}, (s, i) -> s + length(get(m.gaps, i)))"
    both = f"named_struct('hits', regexp_extract_all({text}, r'{pattern}', 0), 'gaps', split({text}, r'{pattern}', -1))"
    return _let("m", both, _let("m", f"named_struct('hits', m.hits, 'gaps', m.gaps, 'starts', {starts})", use))


def _spans(kind: str, exact: bool, offset: str) -> str:
    """The spans of m, for ``_found``."""
    plain = "h" if exact else f"regexp_replace(regexp_replace(h, r'{_AT}', '@'), r'{_DOT}', '.')"
    seen = f"named_struct('value', h, 'plain', {plain}, 'digits', regexp_replace(h, '[^0-9]', ''), 'before', right(get(m.gaps, n), 32), 'after', left(get(m.gaps, n + 1), 1), 'start', get(m.starts, n) + {offset})"
    forms = ["int(length(x.value) > 24)", r"int(x.value RLIKE r'[\[({]')", "int(contains(x.value, ' '))"]
    values = [str(KINDS.index(kind)), "x.start", "x.start + length(x.value)", _PASSES[kind] if exact else "false", *_votes(kind, exact), *forms]
    made = f"named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(_FIELDS, values, strict=True))})"
    return f"CAST(transform(m.hits, (h, n) -> {_let('x', seen, made)}) AS {_SPAN})"


def _loose(text: str, kind: str, offset: str) -> str:
    return f"CASE WHEN {text} RLIKE r'{_HINT[kind]}' THEN {_found(text, LOOSE[kind], _spans(kind, False, offset))} ELSE CAST(array() AS {_SPAN}) END"


def _of(kind: str) -> str:
    """All spans of ``_body`` of a kind: of exact matches, and of loose ones in the gaps."""
    places = "concat(array(0L), transform(m.starts, (s, i) -> s + length(get(m.hits, i))))"
    in_gaps = _let("p", places, f"flatten(transform(m.gaps, (g, j) -> {_loose('g', kind, 'get(p, j)')}))")
    both = _found("_body", EXACT[kind], f"concat({_spans(kind, True, '0L')}, {in_gaps})")
    hint = {"email": "contains(_body, '@')", "phone": "contains(_body, '+')"}.get(kind, f"_body RLIKE r'{_HINT[kind]}'")
    return f"CASE WHEN {hint} AND _body RLIKE r'{EXACT[kind]}' THEN {both} ELSE {_loose('_body', kind, '0L')} END"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, spans): base spans and candidates of each row's text, with votes and forms. Null text is empty; no row moves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    return rows.select("doc_id", F.expr(f"concat({', '.join(map(_of, KINDS))})").alias("spans"))


def vote_patterns(found: DataFrame) -> DataFrame:
    """(kind, each vote, each form, n): how many spans of ``candidates`` have which votes and forms; bounded by the labelers."""
    each = found.select(F.explode("spans").alias("s")).select("s.kind", *[f"s.{n}" for n in (*LABELERS, *FORMS)])
    return each.groupBy("kind", *LABELERS, *FORMS).agg(F.count("*").alias("n"))


_CHANCES = [(n, v) for n in LABELERS for v in VOTES]
#: Log odds that a span with votes p.votes is true, under a model m.
_ODDS = f"aggregate(transform(p.votes, (v, l) -> ln(get(m.yes, l * {len(VOTES)} + v + 1) / get(m.no, l * {len(VOTES)} + v + 1))), ln(m.share / (1 - m.share)), (a, b) -> a + b)"


def _estimated(posteriors: str) -> str:
    """The model from a posterior a pattern of ``all``, with one span of each vote and truth added."""
    total = "aggregate(q, 0D, (a, b) -> a + b)"
    part = f"aggregate(zip_with(all, q, (p, w) -> if(get(p.votes, int(c div {len(VOTES)})) = c % {len(VOTES)} - 1, w, 0D)), 0D, (a, b) -> a + b)"
    chances = f"transform(sequence(0, {len(_CHANCES) - 1}), c -> ({part} + 1) / ({total} + {len(VOTES)}))"
    yes, no = (_let("q", f"zip_with(all, w, (p, y) -> p.n * {y})", chances) for y in ("y", "(1 - y)"))
    share = "(aggregate(zip_with(all, w, (p, y) -> p.n * y), 0D, (a, b) -> a + b) + 1) / (aggregate(all, 0D, (a, p) -> a + p.n) + 2)"
    return _let("w", posteriors, f"named_struct('share', {share}, 'yes', {yes}, 'no', {no})")


def estimate(patterns: DataFrame) -> DataFrame:
    """(kind, share, yes, no): of every kind the share of true spans and each vote's chance on true and on false ones.

    Expectation-maximisation over the counts of at most 3^6 vote patterns of a kind, begun from the mean vote; a kind's
    rounds are one fold in one task. Arrays go by labeler, then vote from -1 to 1. No spans, no rows.
    """
    counts = patterns.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    kinds = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(F.array(*LABELERS).alias("votes"), "n"))).alias("all"))
    begun = _estimated(f"transform(all, p -> 0.5D + 0.45D * aggregate(p.votes, 0, (a, b) -> a + b) / {len(LABELERS)})")
    fold = f"aggregate(sequence(1, {ROUNDS}), {begun}, (m, r) -> {_estimated(f'transform(all, p -> 1 / (1 + exp(-{_ODDS})))')})"
    return kinds.select("kind", F.expr(fold).alias("m")).select("kind", "m.share", "m.yes", "m.no")


def reliabilities(model: DataFrame) -> DataFrame:
    """(kind, labeler, vote, on_true, on_false, share_true) of ``estimate``."""
    each = model.select("kind", "share", F.posexplode(F.arrays_zip("yes", "no")).alias("c", "x"))
    name = F.get(F.array(*map(F.lit, LABELERS)), F.floor(F.col("c") / len(VOTES)).cast("int"))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return each.select(kind.alias("kind"), name.alias("labeler"), (F.col("c") % len(VOTES) - 1).alias("vote"), F.col("x.yes").alias("on_true"), F.col("x.no").alias("on_false"), F.col("share").alias("share_true"))


#: (kind, column, value) of each 0/1 feature: a labeler may weigh differently in each kind.
_FEATURES = [(k, n, v) for k in range(len(KINDS)) for n in (*LABELERS, *FORMS) for v in ((-1, 1) if n in LABELERS else (1,))] + [(k, "kind", k) for k in range(len(KINDS))]


def train(patterns: DataFrame, model: DataFrame) -> list[float] | None:
    """Weights of ``_FEATURES`` and the intercept: logistic regression on each pattern as true and as false, weighed by the posterior.

    None if there is nothing to learn from.
    """
    if patterns.isEmpty():
        return None
    soft = patterns.join(F.broadcast(model), "kind")  # a row a kind
    soft = soft.withColumn("_p", F.expr(_let("p", f"named_struct('votes', array({', '.join(LABELERS)}))", _let("m", "named_struct('share', share, 'yes', yes, 'no', no)", f"1 / (1 + exp(-{_ODDS}))"))))
    marks = ", ".join(f"double(kind = {k} AND {n} = {v})" for k, n, v in _FEATURES)
    sides = "explode(array(named_struct('label', 1D, 'weight', n * _p), named_struct('label', 0D, 'weight', n * (1 - _p))))"
    rows = soft.select(array_to_vector(F.expr(f"array({marks})")).alias("features"), F.expr(sides).alias("s")).select("features", "s.label", "s.weight")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, standardization=False).fit(rows)
    return [float(x) for x in fitted.coefficients] + [float(fitted.intercept)]


def _probability(weights: list[float]) -> str:
    """The classifier on a span s of ``candidates``; weights are looked up by kind and vote."""
    by = dict(zip(_FEATURES, weights[:-1], strict=True))
    table = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})"
    terms = [f"get({table(by.get((k, n, v), 0.0) for k in range(len(KINDS)) for v in VOTES)}, s.kind * {len(VOTES)} + s.{n} + 1)" for n in (*LABELERS, *FORMS)]
    odds = " + ".join([f"{weights[-1]!r}D", f"get({table(by[k, 'kind', k] for k in range(len(KINDS)))}, s.kind)", *terms])
    return f"1 / (1 + exp(-({odds})))"


def personal_data(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, found): every row's spans as (start, kind, end, base, probability), by start, then kind.

    Base spans stay whatever their probability; a candidate comes in at ``least`` or more. Without any candidate or base
    span in the table there is nothing to learn and nothing found. Repeated rows are each judged.
    """
    found = durable(candidates(docs, text), "spans")
    patterns = durable(vote_patterns(found).coalesce(1), "patterns")  # at most 3^6 x 2^3 rows a kind
    weights = train(patterns, estimate(patterns)) or [0.0] * (len(_FEATURES) + 1)
    judged = f"transform(spans, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'base', s.base, 'probability', {_probability(weights)}))"
    return found.select("doc_id", F.expr(f"array_sort(filter({judged}, s -> s.base OR s.probability >= {least!r}D))").alias("found"))


def _joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched; the columns that the contract names (counts are of base spans) and the number of all spans."""
    found = personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    counts = [F.expr(f"bigint(size(filter(found, s -> s.base AND s.kind = {k})))").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
