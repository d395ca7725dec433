"""Operators against brute force, exact round trips or held-out accuracy, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import additive_ann, chat_windows, minhash_dedup, packing, queries, sentencepiece_codec, toxicity

SF = "/root/testdata/sf0.001"
LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


def test_op1(spark, texts):
    lib = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model")).library
    for r in run(spark, "op1_sentencepiece").collect():
        ids = [*lib.encode(texts[r.doc_id] or ""), 2]
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def test_character_map():
    """A double-array trie built here: the longest key wins and its replacement is noted at its source bytes."""
    import struct

    units = [0] * 1024
    base = 256 ^ 0  # children of the root start there
    units[0] = base << 10
    a = base ^ ord("a")
    second = 512
    units[a] = ord("a") | 1 << 8 | (a ^ second) << 10
    units[second] = 1 << 31 | 0  # "a" -> texts[0]
    b = second ^ ord("b")
    third = 768
    units[b] = ord("b") | 1 << 8 | (b ^ third) << 10
    units[third] = 1 << 31 | 2  # "ab" -> texts[2]
    body = struct.pack(f"<{len(units)}I", *units)
    table = sentencepiece_codec.CharacterMap(struct.pack("<I", len(body)) + body + b"X\0YZ\0")
    assert table.longest(b"ab", 0) == (2, b"YZ") and table.longest(b"ac", 0) == (1, b"X") and table.longest(b"ca", 0) is None
    codec = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    old, codec.map = codec.map, table
    try:
        normal, origin = codec.normalise("cab a")
    finally:
        codec.map = old
    assert normal == "▁cYZ▁X" and origin.tolist() == [0, 0, 0, 0, 1, 1, 3, 3, 3, 4, 5]


def test_op2(spark):
    j = run(spark, "op2_language_id").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    assert j.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def brute_components(sets, percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_op3(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = brute_components(sets, 85)
    got = run(spark, "op3_near_duplicates").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), c, c == i) for i, c in want.items()}


@pytest.mark.parametrize("bound, size", [("BLOCK", 20), ("BLOCK_SHINGLES", 3000)])
def test_near_copies_of_all_degrees(spark, monkeypatch, bound, size):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 14), replace=False):
            w[k] = f"x{rng.integers(9_999)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash_dedup, bound, size)  # several blocks a bucket
    want = brute_components({i: shingles(t) for i, t in rows}, 85)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 5


def test_op4(spark, texts):
    toks = {i: [*words(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = run(spark, "op4_class_lm").collect()
    for r in got:
        t = toks[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op4_score(spark, texts):
    """The score recomputed word by word from the classes learned: one class a word in all blocks, bigrams counted here."""
    from corpusloom.llm import byte_words, class_lm

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = class_lm.fold("doc_id", 10) != 0
    blocks = class_lm.durable(class_lm.blocks_of(docs, train, ~train), "blocks").cache()
    learned, _ = class_lm.class_table(blocks)
    words_of_block = {r["block"]: (np.frombuffer(r["words"], np.uint64), class_lm._opened(r["place"], np.uint32)) for r in blocks.collect()}
    label = {}
    for r in learned.collect():
        hashes, place = words_of_block[r["block"]]
        for h, c, n in zip(hashes[place].tolist(), class_lm._opened(r["class"], np.uint8).tolist(), class_lm._opened(r["n"], np.int64).tolist()):
            assert label.setdefault(h, (c, n)) == (c, n)
    end = int(class_lm._END)

    def stream(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        return [*byte_words.words_of(data, np.array([0, len(data)])).hashes().tolist(), end]

    toks = {i: stream(t) for i, t in texts.items()}
    taught = [t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in taught for w in t)
    assert all(label[w][1] == n for w, n in c.items())
    pairs = Counter((label[a][0], label[b][0]) for t in taught for a, b in zip([end, *t], t))
    total, vocabulary, k = sum(c.values()), len(c), class_lm.CLASSES
    size, row, distinct = Counter(), Counter(), Counter(label[w][0] for w in c)
    for (a, b), n in pairs.items():
        size[b] += n
        row[a] += n
    move = {(a, b): (pairs[a, b] + 0.1 * size[b] / total * k) / (row[a] + 0.1 * k) for a in range(k) for b in range(k)}
    unknown = {a: sum(move[a, b] * 0.5 * distinct[b] / max(size[b], 1) for b in range(k)) for a in range(k)}
    got = {r.doc_id: r.score for r in run(spark, "op4_class_lm").collect()}
    for i, t in toks.items():
        want = 0.0
        for a, b in zip([end, *t], t):
            before = label[a][0]
            by_class = move[before, label[b][0]] * (c[b] - 0.5) / size[label[b][0]] if c[b] else unknown[before]
            want += math.log10(0.9 * by_class + 0.1 * (c[b] + 0.1) / (total + 0.1 * (vocabulary + 1)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_op4_large_ids(spark):
    """Ids above 2**53 stay exact beside a null one."""
    from corpusloom.llm import class_lm

    rows = [(9007199254740993, "a b c"), (9007199254740995, "a b d"), (None, "a b"), (-9007199254740993, None)]
    got = class_lm.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.lit(True), F.lit(False))
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}


def test_op5(spark):
    talk = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talk[r.conv_id].append((r.turn, r.role, r.text or ""))
    talk[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in run(spark, "op5_chat_windows").collect()}
    assert set(got) == set(talk)
    for i, t in talk.items():
        t.sort()
        loss = "".join(x[2] for x in t if x[1] == "assistant")
        want = len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        assert tuple(got[i])[1:5] == want
    made = chat_windows.windows(spark.read.parquet(f"{SF}/conversations.parquet"), public_tokenizers.path("byte_bpe_50k.json"), budget=400, history=100).collect()
    for w in made:  # over the budget only by one turn beside the system turn, with no history before it
        assert w.n_tokens <= 400 or len([s for s in w.spans if s.role != "system"]) == 1


def test_op5_windows(spark):
    """Windows chosen again turn by turn: filled in order, history before them, one window where all fits."""
    from corpusloom.llm.byte_bpe import byte_bpe_ids

    bpe, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(6)
    talk = [(c, 7 if c == 3 else t, "system" if t == 0 and c < 3 else ("user", "assistant")[t % 2], "word " * int(rng.integers(0, 150)) + str(t)) for c in range(5) for t in range((1500, 40, 3, 30, 2)[c])]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    made = defaultdict(list)
    for w in chat_windows.windows(rows, bpe, budget=600, history=150).orderBy("window").collect():
        made[w.conv_id].append(w)
    for c in range(5):
        own = [s for w in made[c] for s in w.spans if not s.repeated]
        assert len(own) == sum(t[0] == c for t in talk)
        ends = []
        for w in made[c]:
            parts = [(s, len(byte_bpe_ids(w.text[s.start : s.stop], bpe))) for s in w.spans]
            again, fresh = [n for s, n in parts if s.repeated and s.role != "system"], [n for s, n in parts if not s.repeated and s.role != "system"]
            assert w.n_tokens == sum(n for _, n in parts) and sum(again) <= 150
            assert w.n_tokens <= 600 or len(again) + len(fresh) == 1
            if ends:  # the first new turn did not fit the window before
                assert ends[-1] + fresh[0] > 600
            ends.append(w.n_tokens)
        if sum(n for w in made[c][:1] for n in [w.n_tokens]) and c in (2, 4) and sum(len(byte_bpe_ids(w.text, bpe)) for w in made[c]) <= 600:
            assert len(made[c]) == 1


def test_op5_stretches(spark):
    """The windows of one pass over each conversation, for stretches and partitions of any size; very long turns too."""
    from corpusloom.llm.byte_bpe import byte_bpe_ids

    bpe, rng, budget, history = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(9), 200, 60
    heads = {0: "be kind", 1: "rule " * 1000, 2: "only " * 900, 5: "only"}
    talk = [(c, -1, "system", t) for c, t in heads.items()]
    for c, n in ((0, 300), (1, 40), (3, 1), (4, 200), (None, 50)):
        talk += [(c, t, ("user", "assistant")[t % 2], "word " * int(rng.integers(0, 40) if rng.random() < 0.95 else rng.integers(150, 900)) + str(t)) for t in range(n)]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    tokens = defaultdict(list)
    for r in chat_windows.rendered(rows).collect():
        tokens[r.conv_id].append((r.turn, r.role, len(byte_bpe_ids(r.turn_text, bpe))))
    want = {}
    for c, turns in tokens.items():
        turns.sort()
        head = turns.pop(0) if turns[0][1] == "system" else None
        room, made, at = budget - (head[2] if head else 0), [], 0
        while at < len(turns) or head and not made:
            end, again = at, at
            if turns:
                while again > 0 and sum(t[2] for t in turns[again - 1 : at]) <= history and sum(t[2] for t in turns[again - 1 : at + 1]) <= room:
                    again -= 1
                while end == at or end < len(turns) and sum(t[2] for t in turns[again : end + 1]) <= room:
                    end += 1
            made.append(([(head[0], bool(made))] if head else []) + [(t[0], k < at) for k, t in enumerate(turns[again:end], again)])
            at = end
        want[c] = made
    for many, parts in ((1, 1), (2, 5), (64, 3)):
        got = defaultdict(list)
        for w in chat_windows.windows(rows.repartition(parts), bpe, budget, history, many).orderBy("window").collect():
            got[w.conv_id].append([(s.turn, s.repeated) for s in w.spans])
        assert got == want


def test_op6(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op6_fingerprints").collect()}
    order, gaps = sorted(texts, reverse=True), []
    for k, i in enumerate(order):
        t, follower = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        gaps.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1))
    assert np.std(gaps) < 0.04 and max(map(abs, gaps)) < 0.15


def test_op7(spark):
    """A term that disguises do not hide, and held-out labels."""
    plain = ["the river runs over the old stones", "a market opens early in the morning", "she reads letters near the window", "they walk the dog along the shore"]
    rows = [(i, f"{plain[i % 4]} for you {i % 13}") for i in range(120)] + [(200 + i, f"{plain[i % 4]} you idiot") for i in range(40)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels)
    tests = ["what an idiot", "1d10t", "i d i o t", "i.d.i.o.t!", "iiidiooot", "you !D!0T", "a quiet morning near the shore", "number 1234 and 5678"]
    scores = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(scores[:6]) >= 0.7 and max(scores[6:]) < 0.7


def test_op7_long_runs(spark):
    """Letters spaced out are decoded to the end of the run, whether or not they fit one stretch."""
    plain = ["the river runs over the old stones", "a market opens early in the morning", "she reads letters near the window", "they walk the dog along the shore"]
    rows = [(i, f"{plain[i % 4]} for you {i % 13}") for i in range(120)] + [(200 + i, f"{plain[i % 4]} you idiot") for i in range(40)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    spaced = [" ".join(t.replace(" ", "")) for t in plain]
    tests = [f"{spaced[0]} {spaced[1]} i d i o t", f"{spaced[2]} i d i o t {spaced[3]}", " ".join(spaced * 20) + " 1 d 1 0 t", " ".join(spaced * 20)]
    assert len(tests[0].split()) > 45
    scores = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(scores[:3]) >= 0.7 and scores[3] < 0.7
    one, other = toxicity.Restorer(model["cost"].value), toxicity.Restorer(model["cost"].value)
    other.STRETCH = 7
    for text in [*tests, "1.d-1_0.t" * 30, "i" * 90 + "diot"]:
        assert one.decode(text) == other.decode(text)


def test_op7_long_tokens(spark):
    """A token is decoded however long it is, whole and by the parts that separators join."""
    plain = ["the river runs over the old stones", "a market opens early in the morning", "she reads letters near the window", "they walk the dog along the shore"]
    rows = [(i, f"{plain[i % 4]} for you {i % 13}") for i in range(120)] + [(200 + i, f"{plain[i % 4]} you idiot") for i in range(40)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    joined = ["-".join(t.split()) for t in plain]
    dotted = [".".join(t.replace(" ", "")) for t in plain]
    tests = ["i" * 70 + "diot", f"{joined[0]}_{joined[1]}-1d10t-{joined[2]}", f"{dotted[0]}.i.d.i.o.t.{dotted[1]}", f"{joined[0]}.i.d.1.0.t.{joined[1]}", "the-river-runs-1d10t", f"{joined[0]}_{joined[1]}-{joined[2]}", f"{dotted[0]}.{dotted[1]}", "i" * 70]
    scores = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(scores[:5]) >= 0.7 and max(scores[5:]) < 0.7


def toxic_model(spark):
    plain = ["the river runs over the old stones", "a market opens early in the morning", "she reads letters near the window", "they walk the dog along the shore"]
    rows = [(i, f"{plain[i % 4]} for you {i % 13}") for i in range(120)] + [(200 + i, f"{plain[i % 4]} you idiot") for i in range(40)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)


def test_op7_look_alikes(spark):
    """Doubled letters, accents, wide forms and letters of other scripts; clean ones of each stay."""
    tests = ["iddiioott", "idiiot", "ｉｄｉｏｔ", "іdіоt", "ídíót", "і d і о t", "１ｄ１０ｔ", "iddiott " * 30, "été ça où naïve", "letters and stones run", "ñ ü ß привет"]
    scores = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), toxic_model(spark)).orderBy("doc_id").collect()]
    assert min(scores[:8]) >= 0.7 and max(scores[8:]) < 0.7


def test_op7_viterbi(spark):
    """The best path of a lattice against all of its paths."""
    cost = toxic_model(spark)["cost"].value
    restorer, n = toxicity.Restorer(cost), 28

    def paths(text):
        """(price, text) of every way to read ``text``, as the channel defines them."""
        states = [(0, "", 0.0, "")]
        for at, char in enumerate(text):
            options = [(char, 0.0)] if char.isalpha() else [(x, toxicity.SIGN) for x in toxicity.STANDS_FOR.get(char, "")]
            again = toxicity.REPEATED if at > 1 and char == text[at - 1] == text[at - 2] or text[at + 1 : at + 2] == char == text[at - 1 : at] else toxicity.DOUBLED
            new = []
            for context, last, price, out in states:
                for letter, more in options:
                    code = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    new.append(((context * n + code) % n**3, letter, price + more + float(cost[context, code]), out + letter))
                    if letter == last and at:
                        new.append((context, last, price + more + again, out))
                if not char.isalpha():
                    if 0 < at < len(text) - 1:
                        new.append((context, last, price + (toxicity.SPACED if char == " " else toxicity.THROWN), out))
                    new.append((0, "", price + (float(cost[context, 0]) if context else 0.0) + (0.0 if char == " " else toxicity.ITSELF), out + char))
            states = new
        return [(price + float(cost[context, 0]), out) for context, _, price, out in states]

    for text in ("1d10t", "i d i o t", "iddiott", "r.u-n", "st0nes", "lett3r", "aa1!", "d0g s", "o@o", "winddow"):
        every = paths(text)
        got = restorer.decode(text)
        assert min(p for p, out in every if out == got) == pytest.approx(min(every)[0])


def test_op7_query(spark):
    """Held-out labels of the query itself: no clean text rejected, most toxic ones found (some labels are noise)."""
    folder = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = queries.QUERIES["op7_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r.toxic: r.share for r in seen}
    assert share[0] <= 0.02 and share[1] >= 0.6


def test_special_tokens():
    from tokenizers import Tokenizer

    from corpusloom.llm.byte_bpe import byte_bpe_ids

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext |>", "é <|endoftext|>", "plain"):
        assert byte_bpe_ids(text, path).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 in byte_bpe_ids("a <|endoftext|> b", path)


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    for r in run(spark, "op8_token_counts").collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_within, r.docs_over) == (sizes.count(n), sum(s <= n for s in sizes), sum(s > n for s in sizes))
        assert (r.tokens_total, r.tokens_within, r.tokens_truncated) == (sum(sizes), sum(s for s in sizes if s <= n), sum(min(s, n) for s in sizes))


def test_op9(spark):
    got = defaultdict(set)
    for r in run(spark, "op9_nearest").collect():
        got[r.query_id].add(r.vec_id)
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = 0
    for q, found in got.items():
        best = sorted(((-float(e[q] @ v), i) for i, v in e.items() if i != q))[:20]
        hits += len(found & {i for _, i in best})
    assert len(got) == sum(i % 20 == 0 for i in e) and hits >= 0.9 * 20 * len(got)
    x = np.random.default_rng(1).normal(size=(3000, 32))
    books = additive_ann.train_books(x[:1500], cells=16, books=7, words=64, rounds=3)
    codes = additive_ann.encode(x, books)
    rest = x - sum(books[m][codes[:, m]] for m in range(8))
    assert (rest**2).sum() < 0.45 * (x**2).sum()


def nearest_by_force(x, q, k=20):
    score = (x * x[q]).sum(axis=1)
    return [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:k]


def recall(spark, x, asked):
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in additive_ann.nearest(v, v.where(F.col("vec_id").isin(asked))).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float((x[r.query_id] * x[r.vec_id]).sum()), rel=1e-12)
        got[r.query_id].append(r.vec_id)
    return sum(len(set(got[q]) & set(nearest_by_force(x, q))) for q in asked) / 20 / len(asked)


def test_op9_recall(spark):
    """Many vectors, without structure and in clusters: against brute force."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(12_000, 32)), rng.normal(size=(80, 32)).repeat(100, 0) + 0.3 * rng.normal(size=(8000, 32))])
    assert recall(spark, x, list(range(0, 20_000, 200))) >= 0.95


@pytest.mark.parametrize("scale", [1e30, 1e-30, None])
def test_op9_scale(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)) * (scale or 10.0 ** rng.uniform(-30, 30, 2000)[:, None])
    assert recall(spark, x, list(range(0, 2000, 50))) >= 0.95


def test_op9_repeated_ids(spark):
    """A vec_id with two vectors is found once by each, never by a query of that id, and asks with the lesser one."""
    rows = [(7, [1.0, 2.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (20, [1.0, 1.0]), (20, [0.0, 1.0]), (30, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = additive_ann.nearest(v, v.where("vec_id = 20")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 7, 2.0), (20, 2, 7, 1.0), (20, 3, 30, 0.5)]


def test_op9_hot_cluster(spark):
    """More close vectors than any fixed number of candidates, and queries that must tell them apart: as brute force has it."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2500, 16)), rng.normal(size=16) + 1e-6 * rng.normal(size=(2500, 16))])
    x[7] = x[2600]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in additive_ann.nearest(v, v.where("vec_id % 500 = 100 OR vec_id = 7")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in [*range(100, 5000, 500), 7]:
        assert got[q] == nearest_by_force(x, q)


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, rows = defaultdict(list), run(spark, "op10_packing").collect()
    for r in rows:
        got[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seq) <= 1.005 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_second_pass():
    """Part-filled sequences are packed again: whole pieces, gapless, never more sequences, hardly one above the bound."""
    rng = np.random.default_rng(3)
    for lengths, size in ((rng.integers(1, 20, 300), 20), (rng.integers(1, 8, 40), 20), (np.array([7, 7, 7]), 10), (np.array([], int), 10)):
        for pack in (packing.best_fit, packing.packed):
            sequence, offset = pack(lengths, size)
            for s in set(sequence.tolist()):
                inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
                assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= size
        assert len(set(packing.packed(lengths, size)[0])) <= len(set(packing.sum_of_squares(lengths, size)[0]))


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squared counts is least, recounted here piece by piece."""
    rng = np.random.default_rng(2)
    lengths, size = rng.integers(1, 20, 300), 20
    sequence, offset = packing.sum_of_squares(lengths, size)
    used = {}
    for i in np.argsort(-lengths, kind="stable"):
        gaps = Counter(size - u for u in used.values() if u < size)
        n = int(lengths[i])

        def total(old, new, gaps=gaps):
            c = Counter(gaps)
            if old is not None:
                c[old] -= 1
            if new:
                c[new] += 1
            return sum(v * v for v in c.values())

        best = min([total(g, g - n) for g in gaps if g >= n] + [total(None, size - n)])
        old = used.get(sequence[i])
        assert offset[i] == (old or 0)
        assert total(None if old is None else size - old, size - (old or 0) - n) == best
        used[sequence[i]] = (old or 0) + n


def test_pipeline(spark):
    """Stages against brute force on what they are given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_components({i: shingles(t) for i, t in texts.items()}, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    some = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y z w v u t"), (None, "x y z w v u t"), (2, None), (2, None), (3, "q")]
    left = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(some, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(1, "a b c d e f g"), (None, "x y z w v u t"), (2, None), (3, "q")]))
    clean = corpus_pipeline.keep_clean(spark, docs, SF)
    readable = corpus_pipeline.keep_readable(spark, docs, SF)
    assert clean.count() > 0.8 * len(texts) and readable.count() > 0.95 * len(texts)
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, toxicity.learning_labels(spark.read.parquet(f"{SF}/labels.parquet")))).where(F.col("score") >= toxicity.REJECT).collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - toxic
    without = docs.withColumn("doc_id", F.lit(None).cast("long"))  # rows without an id are judged by their texts
    assert Counter(r.text for r in corpus_pipeline.keep_clean(spark, docs.unionByName(without), SF).where("doc_id IS NULL").collect()) == Counter(r.text for r in clean.collect())
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), run(spark, name)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_op3_repeated_ids(spark):
    """Rows of one doc_id with unlike texts are one document with the links of both, wherever the rows are."""
    a, b = ([f"{x}{i}" for i in range(200)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (8, " ".join([*a, "more"])), (9, " ".join([*b, "more"])), (9, " ".join([*b, "more"])), (7, "something else altogether"), (5, " ".join(b)), (3, "something else altogether")]
    for order in (rows, rows[::-1]):
        for parts in (1, 5):
            got = minhash_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(parts), percent=85).collect()
            assert len(got) == len(rows)
            assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (8, 5, False), (9, 5, False), (7, 3, False), (3, 3, True)}
