import os
import random
import re

import pytest

from postloom.llm import leakage as L
from postloom.llm import pii as P
from postloom.llm import sentences as Z
from postloom.llm import tokenize as K
from postloom.llm import toxicity as X

HAVE_VOCABULARY = os.path.exists(K.VOCABULARY)


def units(text):
    return [text[a:b] for a, b in Z.sentences(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        (" \r\n\t ", []),
        ("# Open questions\n\nIt is slow, e.g. on v3.1. Why?\n- Fixed it. Now\n1. restart", ["# Open questions", "It is slow, e.g. on v3.1.", "Why?", "- Fixed it. Now", "1. restart"]),
        ("* one. two\n* three\n\nEnd", ["* one. two", "* three", "End"]),
        ('"It hung again," he wrote, "and it stalls." Then it stopped ... and went on.', ['"It hung again," he wrote, "and it stalls."', "Then it stopped ... and went on."]),
        ('She typed "Stop. Wait. Go?" into it. (It failed twice.) Next.', ['She typed "Stop. Wait. Go?" into it.', "(It failed twice.)", "Next."]),
        ("We met the U.S. team at 5 p.m. sharp, see sec. 7.2, etc. The rest is fine!", ["We met the U.S. team at 5 p.m. sharp, see sec. 7.2, etc.", "The rest is fine!"]),
        ("A wrapped\nline goes on.\r\nNext one", ["A wrapped\nline goes on.", "Next one"]),
        ("Am 3. Tag blieb es stehen, z. B. unter Last. „Schon wieder!“, schrieb er.", ["Am 3. Tag blieb es stehen, z. B. unter Last.", "„Schon wieder!“, schrieb er."]),
        ("« Il s'arrête. Encore ! » a écrit un ami. M. le support répond.", ["« Il s'arrête. Encore ! » a écrit un ami.", "M. le support répond."]),
        ("Нам нужны экспорт и т. д. до 2.3. «Он падает. Опять!» — написал он.", ["Нам нужны экспорт и т. д. до 2.3.", "«Он падает. Опять!» — написал он."]),
        ("Γιατί κολλάει τη νύχτα; Η τιμή ανέβηκε, π.χ. στο X.", ["Γιατί κολλάει τη νύχτα;", "Η τιμή ανέβηκε, π.χ. στο X."]),
        ("“什么时候修好？”没有人回答。文档（第3.5节）没有……但是。", ["“什么时候修好？”没有人回答。", "文档（第3.5节）没有……但是。"]),
        ("担当者は「止まります。またです！」と書きました。なぜ？", ["担当者は「止まります。またです！」と書きました。", "なぜ？"]),
        ("لماذا يتوقف؟ نقلنا البيانات.", ["لماذا يتوقف؟", "نقلنا البيانات."]),
        ("बिल बढ़ गया। डॉ. साहब ने कहा।", ["बिल बढ़ गया।", "डॉ. साहब ने कहा।"]),
        ("พอตั้งค่า x เป็น 7 ก็หายดี ทีมงานยังไม่ตอบ", ["พอตั้งค่า x เป็น 7 ก็หายดี", "ทีมงานยังไม่ตอบ"]),
        ("Ends here.Has it no space? Is 1.9. a version or a typo?!", ["Ends here.", "Has it no space?", "Is 1.9. a version or a typo?!"]),
        ("It held < endoftext > in the middle. If a < b it stops.", ["It held <", "endoftext", "> in the middle.", "If a < b it stops."]),
        ('An open " quote ends. With the block.', ['An open " quote ends.', "With the block."]),
    ],
)
def test_sentences(text, want):
    assert units(text) == want


@pytest.mark.parametrize("piece, n", [("(a ", 1), ("]", 1), ("«“", 1), ('"a. ', 2), ("(. ", 2), ("- a\n", 2), ("< ", 1)])
def test_scan_is_linear(piece, n):
    """Ten times the text takes about ten times as long, hostile nesting included."""
    import time

    def seconds(k):
        text = piece * k + "]" * k + ")" * k
        began = time.perf_counter()
        Z.sentences(text)
        return time.perf_counter() - began

    small = min(seconds(2_000) for _ in range(3))
    assert seconds(20_000) < 40 * small + 0.5


@pytest.mark.parametrize(
    "text, want",
    [
        ("- one\n  - two goes\n    on here\n- three", ["- one", "- two goes\n    on here", "- three"]),
        ("1. one\n   wrapped. Still it\n2. two\nProse. More", ["1. one\n   wrapped. Still it", "2. two", "Prose.", "More"]),
        ("# Head\n  Prose. More", ["# Head", "Prose.", "More"]),
        ("- one\n\n  Prose. More", ["- one", "Prose.", "More"]),
    ],
)
def test_list_levels(text, want):
    assert units(text) == want


def test_units_cover_all_words():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(['a', "B", " ", "\n", ".", "!", '"', "(", ")", "«", "»", "。", "- ", "1", "etc."]) for _ in range(60))
        spans = Z.sentences(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_sentences_long_text_and_frame(spark):
    assert len(units("One two. " * 20_000)) == 20_000
    df = spark.createDataFrame([(1, "A. B"), (2, None), (1, "A. B"), (None, "C")], "doc_id bigint, text string").selectExpr("*", "1 as start_pos", "2 as id")
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in Z.split_sentences(df).collect()) == [(0, 0, 1), (1, 0, 4), (1, 0, 4)]


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary")
def test_encoding_round_trip_and_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = K.ranks_of(K.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "Hello  world\n\n it's <|endoftext|> fine", "naïve 数据库 ภาษาไทย हिन्दी 👩‍💻", "a" * 3000, "x\t\t y", "Hello  world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in K.encode(df).collect()}
    back = {v: k for k, v in ranks.items()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode_ordinary(t or "")
        assert b"".join(back[x] for x in got[i]).decode() == (t or "")
    assert K.encode(df.limit(0)).collect() == []
    shared = spark.sparkContext.broadcast(K.Transducer.build([b"Hello"], [[15496]]).arrays)
    assert {r.doc_id: list(r.ids) for r in K.encode(df, lexicon=shared).collect()} == got


def test_transducer_numbers_words():
    words = sorted({f"{a}{b}".encode() for a in ("", "re", "un", "pre") for b in ("do", "doing", "cover", "covering", "ing")})
    t = K.Transducer.build(words, [[i] for i in range(len(words))])
    assert list(t.numbers(words)) == list(range(len(words)))
    assert list(t.numbers([b"", b"d", b"redoo", b"xyz"])) == [-1] * 4
    assert len(t.arrays["final"]) < 25  # suffixes are shared
    assert list(K.Transducer.build([], []).numbers([b"a"])) == [-1]


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary")
def test_long_words_merge_alike():
    ranks = K.ranks_of(K.VOCABULARY)
    rng = random.Random(2)
    for n in (600, 513):
        word = "".join(rng.choice("abcdeth ing") for _ in range(n)).encode()
        parts = [word[i : i + 1] for i in range(len(word))]
        short = list(parts)
        while True:
            pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(short, short[1:])]
            if not pairs or min(pairs) == 1 << 60:
                break
            i = pairs.index(min(pairs))
            short[i : i + 2] = [short[i] + short[i + 1]]
        assert K._merge_long(parts, ranks) == [ranks[p] for p in short]


def leak_truth(docs, items, n=12):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda t: {tuple(words(t)[k : k + n]) for k in range(len(words(t)) - n + 1)}
    return {(d, i) for d, t in docs for i, c in items if grams(t) & grams(c)}


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_against_brute_force(spark, edits):
    rng = random.Random(3)
    pool = [f"{a}{b}" for a in ("har", "cop", "wal", "tid", "mead") for b in ("bour", "per", "nut", "al", "ow", "x")]
    text = lambda k: [rng.choice(pool) for _ in range(k)]
    items = [(f"g{i}", " ".join(text(40))) for i in range(12)] + [("short", "only five words are here"), ("none", None)]
    docs = []
    for d in range(60):
        body = text(80)
        if rng.random() < 0.6:
            source = rng.choice(items[:12])[1].split()
            k = rng.choice([10, 11, 12, 13, 30])
            s = rng.randrange(len(source) - k + 1)
            at = rng.randrange(len(body))
            body[at:at] = source[s : s + k]
        docs.append((d, rng.choice([" ", " \n", ", ", " -- "]).join(body).title()))
    docs += [(900, None), (901, "")]
    got = L.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "example_id string, content string"), edits=edits)
    found = {(r.doc_id, r.example_id) for r in got.where("exact_words >= 12").collect()}
    assert found == leak_truth(docs, items) and len(found) > 10


def test_leak_with_an_edit(spark):
    item = "the quiet harbour almanac rejects every seventh row once the walnut archive has been resized twice overnight by us"
    doc = item.replace("walnut", "wallnut")
    run = lambda e: L.leaked_passages(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([("g", item)], "example_id string, content string"), edits=e).collect()
    got = run(1)
    assert [(r.edits, r.doc_to - r.doc_from) for r in got] == [(1, len(doc) + 2)] and got[0].exact_words < 12
    empty = spark.createDataFrame([], "example_id string, content string")
    assert L.leaked_passages(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), empty).collect() == []


def kinds(text):
    return [(text[a:b], k) for a, b, k in P.decode(text, P.weights())]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Call (415) 555-0119 and ask for Radka Obuyaro.", [("(415) 555-0119", "PHONE"), ("Radka Obuyaro", "NAME")]),
        ("Reply-to is <Okello.Dunmerrow@Kestrelmoor.INVALID> on every alert.", [("Okello.Dunmerrow@Kestrelmoor.INVALID", "EMAIL")]),
        ("write to nosterbrand [at] penhalden [dot] invalid now", [("nosterbrand [at] penhalden [dot] invalid", "EMAIL")]),
        ("The dump had a row with SSN QQ 80 38 48 B in plain sight.", [("QQ 80 38 48 B", "ID_NUMBER")]),
        ("Send the disk to Flat 16, 1576 Old Tannery Terrace, Villaserrada.", [("Flat 16, 1576 Old Tannery Terrace, Villaserrada", "ADDRESS")]),
        ("We use driver@8.23, ask @schema_bot954, code 245-48-784.", []),
        ("Its 506 Drive letters and 126 Way joins are a joke.", []),
        ("Mr. Ulrik asked. Harrow Bay is the region. Ticket INC-94236-9313.", []),
        ("I spoke with O'Dunnery, Celestine and Dr. Åsa Trevanyon.", [("O'Dunnery, Celestine", "NAME"), ("Åsa Trevanyon", "NAME")]),
        ("", []),
    ],
)
def test_personal_information(text, want):
    assert kinds(text) == want


def test_marginals_match_enumeration():
    import itertools
    import math

    spans = [(0, 3, 0.5), (2, 5, 1.0), (4, 8, -0.3), (0, 8, 0.2), (6, 9, 0.7)]
    total, each = 0.0, [0.0] * len(spans)
    for n in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), n):
            if all(spans[a][1] <= spans[b][0] or spans[b][1] <= spans[a][0] for a, b in itertools.combinations(chosen, 2)):
                weight = math.exp(sum(spans[i][2] for i in chosen))
                total += weight
                for i in chosen:
                    each[i] += weight
    z, p = P.marginals(spans)
    assert abs(z - math.log(total)) < 1e-9
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(p, each))


def test_neighbours_in_decoding_and_expectation(monkeypatch):
    """Best set and expected counts with features of neighbours, against enumeration of all sets."""
    import itertools
    import math

    rng = random.Random(5)
    for _ in range(40):
        spans = sorted({(a, a + rng.randrange(2, 9), rng.choice(P.KINDS)) for a in (rng.randrange(60) for _ in range(7))})
        w = {f"f{i}": rng.uniform(-2, 2) for i in range(len(spans))}
        for a, b in itertools.product(P.KINDS, P.KINDS):
            w.update({f"{a} then {b} {k}": rng.uniform(-2, 2) for k in ("touching", "near")})
        best, total, counts = (0.0, []), 0.0, {}
        for n in range(len(spans) + 1):
            for chosen in itertools.combinations(range(len(spans)), n):
                chosen = sorted(chosen, key=lambda i: spans[i])
                if all(spans[a][1] <= spans[b][0] for a, b in zip(chosen, chosen[1:])):
                    between = [P.neighbours(spans[a], spans[b]) for a, b in zip(chosen, chosen[1:])]
                    score = sum(w[f"f{i}"] for i in chosen) + sum(w[f] for f in between if f)
                    best = max(best, (score, [spans[i] for i in chosen]))
                    total += math.exp(score)
                    for f in between:
                        if f:
                            counts[f] = counts.get(f, 0.0) + math.exp(score)
        monkeypatch.setattr(P, "candidates", lambda text, spans=spans: [(a, b, k, [f"f{i}"]) for i, (a, b, k) in enumerate(spans)])
        assert P.decode("x" * 80, w) == best[1]
        z, _, expected = P.expectations([(a, b, w[f"f{i}"]) for i, (a, b, _) in enumerate(spans)], [k for *_, k in spans], w)
        assert abs(z - math.log(total)) < 1e-6
        assert all(abs(expected[f] - v / total) < 1e-6 for f, v in counts.items())


@pytest.mark.parametrize("frame", ["Kind regards, {}", "Who at Acme Labs is {}?", "Please ask for {}.", "I spoke with {} last week.", "Contact: {}, +49 30 23125 111", "Dr. {} said so."])
def test_names_by_context_alone(frame):
    w, at = P.weights(), frame.index("{")
    assert sum((at, at + len(n), "NAME") in P.decode(frame.format(n), w) for n in HELD_OUT) >= 7


def test_long_text_of_capitals():
    import time

    began = time.perf_counter()
    P.decode("AB CD EF " * 20_000 + "van der " * 20_000 + "Dr. " * 20_000, P.weights())
    assert time.perf_counter() - began < 30


def test_trained_weights_hold_out():
    from postloom.llm import pii_training as T

    w, rng, hit, found, true = P.weights(), random.Random(99), 0, 0, 0
    for _ in range(300):
        text, gold = T.sentence(rng)
        got, want = {(a, k) for a, _, k in P.decode(text, w)}, {(a, k) for a, _, k in gold}
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert hit / found > 0.97 and hit / true > 0.95


def test_redaction(spark):
    df = spark.createDataFrame([("e", None, "Text me on 07700 900376, please. Ünï"), ("e", "", None)], "evidence_id string, title string, content string").selectExpr("*", "1 as id")
    got = [tuple(r) for r in P.redact(df, "evidence_id", "title", "content").collect()]
    assert sorted(got, key=str) == sorted([("e", None, "Text me on [PHONE], please. Ünï"), ("e", "", None)], key=str)
    assert [(r.field_name, r.kind, r.start_pos) for r in P.find(df, "evidence_id", "title", "content").collect()] == [("content", "PHONE", 11)]


def brute_best(scores):
    return max([0.0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])


def test_segments_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    parts = [rng.normal(-0.3, 2, n) for n in (0, 1, 7, 30, 0, 12)]
    counts = np.array([len(p) for p in parts])
    best = X.best_segments(np.concatenate(parts)[:, None], counts)[:, 0]
    for p, b in zip(parts, best):
        assert abs(b - brute_best(p)) < 1e-6
        segs = X.segments(p)
        assert all(x[1] <= y[0] for x, y in zip(segs, segs[1:]))
        assert abs(max([s for _, _, s in segs], default=0.0) - b) < 1e-6


def test_disguises():
    reader = X.Reader({"idiot", "nudes", "bastards", "porn"})
    reader.raw = ["porn", "idiot"]
    assert reader.tokens("1d10t n.u.d.e.s b4$t4rds p**n idiooooot") == ["idiot", "nudes", "bastards", "porn", "idiot"]
    assert reader.tokens("id​iot nudеs") == ["idiot", "nudes"]
    assert reader.tokens("v14.2 and 55 rows") == ["#", "#", "and", "#", "rows"]


def test_toxic_passages(spark):
    insults = ["You are a complete cretin and your code proves it.", "Shut up, you scumbag, nobody asked.", "Never hire Veldrans, they are all thieves by nature.", "DM me for horny singles, cheap and fast."]
    labels = ["abusive", "abusive", "hateful", "sexual"]
    plain = ["The retry queue stalls every night.", "I hate this planner with a passion.", "The setup is idiot-proof, even I managed.", "We moved the archive to a larger plan.", "The naked domain does not resolve."]
    rng = random.Random(6)
    sample = [(f"{rng.choice(plain)} {t} {rng.choice(plain)}", c) for t, c in zip(insults, labels) for _ in range(8)] + [(" ".join(rng.sample(plain, 3)), "none") for _ in range(60)]
    sample_df = spark.createDataFrame(sample + [(None, "none"), ("x", None)], "text string, category string")
    rows = [(f"e{i}", f"s{i % 3}", " ".join(rng.sample(plain, 4))) for i in range(90)] + [(f"t{i}", None, f"{plain[0]} {t} {plain[3]}") for i, t in enumerate(insults)] + [("n", "s0", None), ("m", "s0", "")]
    df = spark.createDataFrame(rows, "evidence_id string, source_name string, content string").selectExpr("*", "1 as id", "2 as abusive_")
    scored = X.score(df, X.fit(df, "content", sample_df), "evidence_id", "content", "source_name").cache()
    got = {r.evidence_id: r.categories for r in scored.where("categories is not null").collect()}
    assert got == {f"t{i}": [c] for i, c in enumerate(labels)}
    assert scored.count() == len(rows)
    by = {r.source_name: (r.rows, r.flagged) for r in X.rates(scored).collect()}
    assert by[None] == (4, 4) and by["s0"] == (32, 0)


def test_harmless_sentences_of_labelled_texts_are_not_learned(spark):
    """A product that only toxic labelled texts name by chance, and a lexicon without entries."""
    plain = [f"We moved the {a} from {b} to the new plan." for a in ("archive", "index", "ledger") for b in ("Alder", "Birch", "Cedar")]
    rng = random.Random(2)
    sample = [(f"{rng.choice(plain)} You are a complete {w} and the patch proves it.", "abusive") for w in ("cretin", "moron", "dimwit") * 4]
    sample += [(f"We moved the ledger from Umberley to the new plan. {t}", "sexual") for t in ("Click here for nudes.", "Click here for porn.")]
    sample += [(" ".join(rng.sample(plain, 3)), "none") for _ in range(40)]
    rows = [(i, " ".join(rng.sample(plain, 3))) for i in range(300)] + [(1000 + i, "We moved the index from Umberley to the new plan.") for i in range(40)] + [(2000, "You are a complete moron and the patch proves it.")]
    df = spark.createDataFrame(rows, "id int, content string")
    lexicon, X.LEXICON = X.LEXICON, {**X.LEXICON, "sexual": ""}
    try:
        model = X.fit(df, "content", spark.createDataFrame(sample, "text string, category string"))
    finally:
        X.LEXICON = lexicon
    assert [r.id for r in X.score(df, model, "id", "content").where("categories is not null").collect()] == [2000]
    assert (model.scale > 0).all() and (model.size > 0).all()


def test_sample_without_categories(spark):
    df = spark.createDataFrame([(1, "All is well."), (2, None)], "id int, content string")
    model = X.fit(df, "content", spark.createDataFrame([], "text string, category string"))
    assert {r.id: r.abusive for r in X.score(df, model, "id", "content").collect()} == {1: 0.0, 2: 0.0}


HELD_OUT = ["Oluwaseun Adebayo", "Priya Raghunathan", "Svetlana Morozova", "Giuseppe Ferrante", "Hyejin Baek", "Tomasz Wisniewski", "Leilani Kahale", "Dragan Petkovic"]


def test_names_outside_lexicon_and_training():
    w = P.weights()
    assert not {x.lower() for n in HELD_OUT for x in n.split()} & P._NAMES
    found = sum((0, len(n), "NAME") in P.decode(f"{n} of Blue Gantry closed the case without a word.", w) for n in HELD_OUT)
    assert found >= 6, found
    assert not any(k == "NAME" for t in ("Der Dienst von Ochredb steht still.", "We moved to Velvetine SQL.", "Hexham Tools closed it.") for _, _, k in P.decode(t, w))
