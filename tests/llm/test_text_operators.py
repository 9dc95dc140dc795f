import math
import re
import textwrap
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, ROWS, by_text, collected, documents, words
from pyspark.sql import functions as F

from statloom.llm import chat, language_id, language_model, licenses, packing, pieces
from statloom.llm.chat import TemplateError, compile_template, format_chats, read_back, read_turns
from statloom.llm.language_id import CodeModel, codewords, held_out
from statloom.llm.queries import QUERIES, TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def learning(id_, folds, fold):
    return id_ is None or zlib.crc32(str(id_).encode()) % folds != fold


# ---- language

def test_language_id_of_odd_rows(spark):
    got = by_text(collected(language_id.language_id(documents(spark))))
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    assert len(got) == len(ROWS)
    for i in (4, 5, 6, 7):
        assert by_id[i][0][2:] == ("und", 0.0, True)
    assert all(r[2] in ("en", "fr") and 0 <= r[3] <= 1 for i in (1, 2, 3, 8, 12) for r in by_id[i])
    assert by_id[8][0][2] == "fr" and by_id[12][0][2] == "en"
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in got)


def test_language_id_of_nothing(spark):
    assert language_id.language_id(documents(spark, [])).collect() == []


def test_language_id_without_labels(spark):
    rows = [(i, t, None) for i, t, _ in ROWS[:6]]
    assert {r.lang_pred for r in language_id.language_id(documents(spark, rows)).collect()} == {"und"}


def test_held_out_accuracy_and_inputs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.97
    # labels and sources of held-out rows change nothing
    out = held_out("doc_id", 5, 0)
    other = docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    a = sorted(map(tuple, language_id.language_id(docs).collect()))
    assert a == sorted(map(tuple, language_id.language_id(other).collect()))


@pytest.mark.parametrize("labels", [2, 3, 4, 7, 8, 30])
def test_codewords_are_apart(labels):
    code = codewords(labels)
    apart = min((code[i] != code[j]).sum() for i in range(labels) for j in range(i))
    assert apart >= (2 ** (labels - 2) if labels <= 7 else 3)
    assert ((code == 1).any(0) & (code == -1).any(0)).all()


def blank_model(labels):
    return CodeModel(list(labels), np.zeros(0, np.int64), np.zeros((0, codewords(len(labels)).shape[1]), np.float32), np.zeros(0))


def model_by_hand(rows):
    """Counts, weights, scales by plain dictionaries: every n-gram of the letters of every labelled text."""
    counts = {}
    for text, label in rows:
        cells = counts.setdefault(label, Counter())
        for piece in [text[i:i + language_id.PIECE] for i in range(0, len(text), language_id.PIECE)]:
            kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in piece.lower())
            if not any(unicodedata.category(c)[0] == "L" for c in kept):
                continue
            b = f"  {' '.join(kept.split(' ')).strip()}  "
            b = re.sub(" +", " ", b.strip()).join(["  ", "  "]).encode()
            for n in language_id.ORDERS:
                for i in range(len(b) - n + 1):
                    code = int.from_bytes(b[i:i + n], "big")
                    cells[(code * 8 + n) * 0x9E3779B97F4A7C15 % 2**64 >> 48] += 1
    labels = sorted(counts)
    total = {label: sum(counts[label].values()) + 0.5 * language_id.BUCKETS for label in labels}
    share = {label: lambda g, label=label: (counts[label][g] + 0.5) / total[label] for label in labels}
    code = codewords(len(labels))
    weights = {}
    for g in set().union(*counts.values()):
        means = [[np.mean([share[x](g) for i, x in enumerate(labels) if code[i, bit] == sign]) for sign in (1, -1)] for bit in range(code.shape[1])]
        weights[g] = [math.log(up) - math.log(down) for up, down in means]
    spread = [math.sqrt(sum(w[bit] ** 2 * np.mean([share[x](g) for x in labels]) for g, w in weights.items())) for bit in range(code.shape[1])]
    return labels, weights, [1 / max(s, 1e-6) for s in spread]


def test_counts_weights_and_loss_by_hand(spark):
    texts = [("le renard brun saute été ½", "fr"), ("the quick brown fox", "en"), ("der schnelle braune Fuchs", "de"), ("THE lazy dog 12", "en"), ("² 34 !", "de"), (None, "de"), ("no label", None)]
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)])
    model = language_id.fit(docs)
    labels, weights, scale = model_by_hand([(t, x) for t, x in texts if t and x])
    assert model.labels == labels and set(np.flatnonzero(model.seen)) == set(weights)
    for g, w in weights.items():
        assert model.weights[g] == pytest.approx(w, rel=1e-5, abs=1e-6)
    assert model.scale == pytest.approx(scale, rel=1e-4)
    for text in ("ein brauner fox", "le quick été", "unbekannt zzz"):
        grams = np.concatenate(list(language_id.grams(text)))
        known = [g for g in grams.tolist() if g in weights]
        margins = [sum(weights[g][bit] for g in known) / max(len(known), 1) * scale[bit] for bit in range(len(scale))]
        losses = [np.mean([math.exp(-max(-20, min(20, c * m))) for c, m in zip(row, margins, strict=True)]) for row in model.code]
        best = int(np.argmin(losses))
        shares = [math.exp(-8 * (x / losses[best] - 1)) for x in losses]
        got = model.predict(text)
        assert got[0] == labels[best] and got[1] == pytest.approx(shares[best] / sum(shares), rel=1e-3)
        assert (got[3] == language_id.UNFAMILIAR) == (len(known) < language_id.SEEN * len(grams))


def test_letters_are_letters(spark):
    rows = [(1, "the quick fox", "en"), (2, "le renard brun", "fr"), (3, "² ½ ①", None), (4, "Ⅷ ७ ٣", None), (5, "ª", None)]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(documents(spark, rows), folds=1000, fold=1000).collect()}
    assert got[3] == got[4] == "und" and got[5] in ("en", "fr")


def test_unlearned_languages_are_ambiguous(spark, folder):
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    for text in ("Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ つねならむ", "Τάχιστη αλώπηξ βαφής ψημένη γη"):
        label, _, ambiguous, reason = model.predict(text)
        assert label in model.labels and ambiguous and reason == language_id.UNFAMILIAR


def test_many_labels(spark, monkeypatch):
    """More labels than a task holds at once, without a limit on their number."""
    monkeypatch.setattr(language_id, "HELD_LABELS", 7)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(12)), f"l{i:03d}") for i in range(600)]
    model = language_id.fit(documents(spark, rows))
    assert len(model.labels) == 600
    assert sum(model.predict(rows[i][1])[0] == rows[i][2] for i in range(0, 600, 20)) >= 27


def test_decoding_corrects_a_wrong_bit():
    model = blank_model("abcd")
    for label in range(4):
        for wrong in range(7):
            margins = model.code[label].astype(float)
            margins[wrong] *= -1
            assert model.decode(margins)[0] == label
    assert model.decode(np.zeros(7))[2]


# ---- pieces

def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _fields(raw):
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            n, shift, at, last = n | (raw[at] & 127) << shift, shift + 7, at + 1, raw[at]
            if last < 128:
                return n

    while at < len(raw):
        start, key, value = at, number(), b""
        if key & 7 == 2:
            size = number()
            value, at = raw[at:at + size], at + size
        elif key & 7 == 0:
            number()
        else:
            at += 4 if key & 7 == 5 else 8
        yield key >> 3, value, raw[start:at]


def best_score_model():
    """The library's own best-score search over the same pieces: the model's type set to unigram."""
    out = b""
    for field, value, raw in _fields(open(MODEL, "rb").read()):
        if field == 2:
            spec = b"".join(r if f != 3 else b"\x18\x01" for f, _, r in _fields(value))
            raw = b"\x12" + _varint(len(spec)) + spec
        out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_segmentation_has_the_best_score(folder, spark):
    own, library = pieces.Encoder(pieces.load(MODEL)), best_score_model()
    score = {i: s for _, i, s in own.vocabulary.pieces}
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect()]
    vocabulary = sorted({w for t in texts for w in t.split()})
    assert len(vocabulary) > 1000
    for word in [*vocabulary, "naïve", "日本語", "\U0001f600", "aaaaaaaaaaaaaaaaaaaa", "<s>"]:
        best = library.nbest_encode(word, nbest_size=2, out_type=int)[0]
        mine = own.encode(word).tolist()
        assert mine == best or sum(score.get(i, 0) for i in mine) == sum(score.get(i, 0) for i in best), word


def test_round_trip_of_odd_rows(spark):
    docs = documents(spark)
    ids = pieces.encode(docs, MODEL)
    back = pieces.decode(ids, MODEL)
    assert by_text(collected(back)) == by_text([(i, t) for i, t, _ in ROWS])
    sizes = {r.doc_id: r.n for r in ids.select("doc_id", F.size("ids").alias("n")).collect()}
    assert sizes[5] == 0 and sizes[12] > 300_000
    assert pieces.encode(documents(spark, []), MODEL).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t▁é日\U0001f600<>x0A")), max_size=30) | st.text(max_size=20))
def test_any_text_round_trips(text):
    vocabulary = pieces.load(MODEL) if not hasattr(test_any_text_round_trips, "v") else test_any_text_round_trips.v
    test_any_text_round_trips.v = vocabulary
    own = pieces.encoder(vocabulary)
    text = text.encode("utf-8", "ignore").decode()
    lists = pa.array([own.encode(text), None, []], pa.list_(pa.int32()))
    assert pieces.decode_lists(lists, pieces.piece_bytes(vocabulary), vocabulary.dummy_prefix) == [text, None, ""]


def test_words_are_cut_where_pieces_end():
    """Cutting at spaces and lines changes nothing: the whole text at once has the same score."""
    own = pieces.Encoder(pieces.load(MODEL))
    for text in ("a  b\n\n c d   e", "one two\nthree", "   ", "\n", "x\n ", " \nab ab"):
        score = {i: s for _, i, s in own.vocabulary.pieces}
        total = lambda ids: sum(score.get(i, 0) for i in ids)
        assert total(own.encode(text).tolist()) == total(own.best(" " + text)[0])


# ---- chat

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, None, None),
         (None, 3, "user", "x"), (None, None, "system: y", "a\n\n"), (3, 0, "assistant", ""), (3, 1, "assistant", "### user: no</turn>\n### assistant: \\"),
         (4, 0, "ass\\istant", "\\\\"), (5, 0, "user", LONG), (-9, 2, "assistant", "zwei"), (-9, 1, "assistant", "eins")]


def chats(spark, rows=CHATS):
    c, t, r, x = zip(*rows, strict=True) if rows else ((),) * 4
    return spark.createDataFrame(pa.table({"conv_id": pa.array(c, pa.int64()), "turn": pa.array(t, pa.int64()), "role": pa.array(r, pa.string()),
                                           "text": pa.array(x, pa.string()), "conv": pa.array(c, pa.int64()), "spans": pa.array(r, pa.string())}))


def test_chats_read_back(spark):
    want = {}
    for c, t, r, x in sorted(CHATS, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    formatted = format_chats(chats(spark))
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: r.loss_text for c, r in got.items()} == {c: "".join(x for r, x in turns if r == "assistant") for c, turns in want.items()}
    assert format_chats(chats(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="as:\\#</turn>\n ", max_size=12), st.text(alphabet="\\#</turn>\n :a", max_size=25)), max_size=5))
def test_any_turns_read_back(turns):
    text, _ = compile_template(chat.TURNS)([{"role": r, "text": t} for r, t in turns])
    assert read_turns(text) == turns


def test_templates():
    messages = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b", "n": 3}]
    render = compile_template("{% set x = 'A' + 'B' %}{{ x }}{% for m in messages %}{% if loop.first %}<{% elif not (m.role == 'user') and loop.last %}>{% else %}?"
                              "{% endif %}{{ m['text'] | upper }}{{ loop.index0 }}{{ '!' if m.n == 3 else '' }}{# no #}{% endfor %}{{ messages | length }}")
    assert render(messages)[0] == "AB<A0>B1!2"
    text, spans = compile_template("é{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}|{% endfor %}")(messages)
    assert text == "éa|b|" and spans == [(1, 2), (3, 4)]
    assert compile_template("a  {%- if true -%}  b  {%- endif %} c")([])[0] == "ab c"


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}{{ 'd' | upper }}")) == ("block", ("print", ("const", "ab1cD")))


@pytest.mark.parametrize("source", ["{{ f() }}", "{{ x | system }}", "{% import os %}", "{% for m in messages %}", "{{ }}", "{{ 'a' 'b' }}", "{% endif %}", "{{ a.b( }}"])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_templates_reach_no_python_objects():
    with pytest.raises(TemplateError):
        compile_template("{{ messages.__class__ }}")([])
    assert compile_template("{{ open }}{{ messages[0] }}")([])[0] == ""


def test_pieces_query_returns_the_ids(spark, folder):
    got = QUERIES["op2_sentencepiece"][0](spark, folder).limit(50)
    docs = {r.doc_id: r for r in pieces.encode(spark.read.parquet(f"{folder}/documents.parquet"), MODEL).collect()}
    rows = got.collect()
    assert rows and all(r.ids == docs[r.doc_id].ids and r.n_ids == len(r.ids or []) and r.round_trip for r in rows)


# ---- licences

def test_equivalent_texts_are_one():
    mit = licenses.KNOWN["MIT"][0]
    same = "/* Copyright (c) 2020 Nobody */\n" + mit.upper().replace(",", " ;").replace("\n\n", "\n\n\n").replace("COPYRIGHT HOLDERS", "copyright   holders")
    assert licenses.digest(same) == licenses.digest(mit) != licenses.digest(mit + " extra")
    assert licenses.digest("Sub-licence, colour") == licenses.digest("SUB LICENSE (colour)")
    assert licenses.digest("© 2020 a\n(c) b\n!!") is None


def test_license_scan_of_odd_rows(spark):
    mit = licenses.KNOWN["MIT"][0]
    more = [(20, mit, "en"), (21, f"Some text\n\n{mit}\n\nMore text.", "en"), (22, "x\nreleased under the mit licence\ny", "en"), (20, mit, "en")]
    got = collected(licenses.license_scan(documents(spark, ROWS + more)).select("doc_id", "unit", "start", "license_id"))
    texts = [r for r in got if r[1] == "text"]
    assert by_text([(r[0], r[3]) for r in texts]) == by_text([(i, "MIT" if i == 20 else None) for i, _, _ in ROWS + more])
    assert by_text([r for r in got if r[1] != "text"]) == by_text([(21, "block", 11, "MIT"), (22, "line", 2, "MIT-notice")])
    assert licenses.license_scan(documents(spark, [])).collect() == []


def test_units_are_where_they_say():
    text = "a\nb\n \n\nc d\n\n\n\ne\nf"
    for _, start, part in licenses.units(text):
        assert text[start:start + len(part)] == part
    assert [p for kind, _, p in licenses.units(text) if kind == "line"] == ["a", "b", " ", "c d", "e", "f"]


def test_published_licenses_inside_documents(spark):
    mit = licenses.KNOWN["MIT"][0]
    title, body = mit.split("\n\n", 1)
    apart = f"{title}\n\nCopyright (c) 2020 Nobody\n\n\n\n{body}"
    shared = "/usr/share/common-licenses"
    gpl, apache = (open(f"{shared}/{n}", encoding="utf8").read() for n in ("GPL-3", "Apache-2.0"))
    notice = apache[apache.index("   Licensed under the Apache"):].strip()
    inside = [apart, body, gpl, apache, notice, open(f"{shared}/BSD", encoding="utf8").read(), "/*\n * SPDX-License-Identifier: MPL-2.0\n */"]
    rows = [(i, f"Some text\n\n{t.strip()}\n\nMore text.", "en") for i, t in enumerate(inside)] + [(10, apart, "en"), (11, gpl, "en")]
    got = collected(licenses.license_scan(documents(spark, rows)).where("license_id IS NOT NULL").select("doc_id", "unit", "start", "license_id"))
    names = ["MIT", "MIT", "GPL-3.0", "Apache-2.0", "Apache-2.0-notice", "BSD-3-Clause", "MPL-2.0-notice"]
    assert by_text(r for r in got if r[0] < 10 and r[1] == "block") == by_text(
        (i, "block", rows[i][1].index("Redistribution") if i == 5 else 11, n) for i, n in enumerate(names))
    assert by_text(r for r in got if r[1] == "text") == [(10, "text", 0, "MIT"), (11, "text", 0, "GPL-3.0")]


def test_own_table_of_licenses(spark):
    known = licenses.known_digests(spark, {"own": ["one two\n\nthree four\n\nfive"]})
    rows = [(1, "x\n\none\ntwo three\n\n(c) me\n\nfour\nfive\n\ny", "en"), (2, "one two\n\nthree four\n\nsix", "en")]
    got = collected(licenses.license_scan(documents(spark, rows), known).where("license_id IS NOT NULL").select("doc_id", "unit", "start", "license_id"))
    assert got == [(1, "block", 3, "own")]


# ---- language model

def test_scores_of_odd_rows(spark):
    rows = ROWS + [(100 + i, f"the cat {w} on the mat", "en") for i, w in enumerate(("sat", "sat", "lay", "slept"))]
    got = by_text(collected(language_model.score_texts(documents(spark, rows), ~held_out("doc_id", 7, 2))))
    tokens = [[*(w for w in words(None if t is None else t.encode().lower().decode())), None] for _, t, _ in rows]
    learns = [learning(i, 7, 2) for i, _, _ in rows]
    count = Counter(w for t, flag in zip(tokens, learns, strict=True) if flag for w in t)
    pairs = Counter(p for t, flag in zip(tokens, learns, strict=True) if flag for p in zip([0, *t[:-1]], t, strict=True))
    n, v, prior, begins = sum(count.values()), len(count), language_model.PRIOR, sum(learns)
    alone = lambda w: (count[w] + 1) / (n + v + 1)
    want = []
    for (id_, _, _), t in zip(rows, tokens, strict=True):
        base = sum(math.log10(alone(w)) for w in t)
        score = sum(math.log10((pairs[h, w] + prior * alone(w)) / ((begins if h == 0 else count[h]) + prior)) for h, w in zip([0, *t[:-1]], t, strict=True))
        want.append((id_, len(t), sum(count[w] > 0 for w in t), n, base, score))
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], abs=2e-4 * b[1])


def test_scores_of_nothing_and_without_learning(spark):
    assert language_model.score_texts(documents(spark, []), F.lit(True)).collect() == []
    got = language_model.score_texts(documents(spark, ROWS[:6]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50) | st.integers(0, 300), max_size=200, unique=True), st.lists(st.integers(0, 2**50) | st.integers(0, 300), max_size=50))
def test_elias_fano_finds_what_is_there(values, asked):
    values = np.array(sorted(values), np.uint64)
    n, width, low, high = language_model.EliasFano.encode(values)
    level = language_model.EliasFano(n, width, low, high)
    asked = np.array(asked + values.tolist(), np.uint64)
    where = {int(v): i for i, v in enumerate(values)}
    assert level.find(asked).tolist() == [where.get(int(v), -1) for v in asked]


def test_trie_answers_pairs(tmp_path):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 600), rng.integers(0, 5000, 600), strict=True)})
    contexts = np.array(sorted({a for a, _ in pairs}), np.uint64)
    rank = {int(c): i for i, c in enumerate(contexts)}
    keys = np.array([rank[a] * 5000 + b for a, b in pairs], np.uint64)
    language_model.Trie.write(str(tmp_path / "t"), contexts, keys, np.arange(1, len(keys) + 1), 5000)
    trie = language_model.Trie(str(tmp_path / "t"), 5000)
    for a in range(45):
        asked = np.unique(np.r_[rng.integers(0, 5000, 60), [b for c, b in pairs if c == a][:20]]).astype(np.uint64)
        got = trie.code(np.array([a], np.uint64), np.array([len(asked)]), asked)
        assert got.tolist() == [pairs.index((a, int(b))) + 1 if (a, int(b)) in pairs else 0 for b in asked]


def test_model_probabilities_sum_to_one(spark):
    """All continuations of one context, scored as two-word texts beside one model."""
    base = [(i, t, None) for i, t in enumerate(["a b", "a c", "a b", "b a"])]
    vocabulary = ["a", "b", "c", "never"]
    rows = base + [(100 + i, f"a {w}", None) for i, w in enumerate(vocabulary)] + [(200, "a", None), (201, "", None)]
    got = {r.doc_id: r for r in language_model.score_texts(documents(spark, rows), F.col("doc_id") < 100).collect()}
    # P(a | begin) P(w | a) P(end | w), the last by itself from a text that is just w
    counts = Counter("a b end a c end a b end b a end".split())
    n, v, m = sum(counts.values()), len(counts), language_model.PRIOR
    pairs = Counter([("a", "b"), ("b", "end"), ("a", "c"), ("c", "end"), ("a", "b"), ("b", "end"), ("b", "a"), ("a", "end")])
    p = lambda w: (counts[w] + 1) / (n + v + 1)
    end = lambda w: (pairs[w, "end"] + m * p("end")) / (counts[w] + m)
    start = 10 ** got[200].score / end("a")
    total = sum(10 ** got[100 + i].score / start / end(w) for i, w in enumerate(vocabulary)) + end("a")
    assert total == pytest.approx(1, abs=1e-3)


# ---- packing

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sets(st.integers(1, 64), max_size=4))
def test_bins_hold_their_items(lengths, sizes):
    sizes = tuple({*sizes, 64})
    placed = packing.pack([(n, i) for i, n in enumerate(lengths)], sizes, 2)
    assert sorted(k for k, *_ in placed) == list(range(len(lengths)))
    bins = {}
    for key, bin_, offset, size in placed:
        bins.setdefault((bin_, size), []).append((offset, lengths[key]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), items in bins.items():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False))
        used = sum(n for _, n in items)
        assert size == min(s for s in sizes if s >= used)


def test_sizes_are_chosen_by_cost():
    assert packing.pack([(10, 0)], (16, 64), 4) == [(0, 0, 0, 16)]
    many = packing.pack([(16, i) for i in range(8)], (16, 64), 16)
    assert {s for *_, s in many} == {64} and len({b for _, b, *_ in many}) == 2
    assert {s for *_, s in packing.pack([(16, i) for i in range(8)], (16, 64), 0)} == {16}


def test_packing_of_odd_rows(spark):
    got = packing.best_fit_packing(documents(spark), sizes=(256, 1024), shard_pieces=64).toPandas()
    want = Counter()
    for i, t, _ in ROWS:
        want[i] += len(words(t))
    for i, n in want.items():
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        assert own.n_words.sum() == n
    assert (got.n_words == 0).sum() == got.bin_id.isna().sum() == 3
    bins = got.dropna(subset=["bin_id"]).groupby("bin_id").agg(n=("n_words", "sum"), size=("bin_size", "first"))
    assert (bins.n <= bins["size"]).all() and bins.n.sum() / bins["size"].sum() > 0.97
    pieces_ = got[got.doc_id == 12].sort_values("piece")
    assert (pieces_.start == pieces_.piece * 1024).all()
    assert packing.best_fit_packing(documents(spark, [])).collect() == []


# ---- packing by brute force

def packed_by_hand(lengths, sizes, overhead):
    """Every bin looked at for every piece, longest first: (size, lengths in order of their places) of each bin."""
    left, bins = sorted(lengths, reverse=True), []

    def filled(room, rest):
        used = 0
        for n in sorted(rest, reverse=True):
            if used + n <= room:
                used += n
        return used

    while left:
        n = left.pop(0)
        open_ = [b for b in bins if b[0] - sum(b[1]) >= n]
        if open_:
            min(open_, key=lambda b: b[0] - sum(b[1]))[1].append(n)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / (n + filled(s - n, left)), s))
            bins.append((size, [n]))
    return Counter((min(s for s in sizes if s >= sum(held)), tuple(held)) for _, held in bins)


@pytest.mark.parametrize("shard_pieces", [5, 8192])
@pytest.mark.parametrize("sizes", [(64,), (16, 32, 128), (512, 1024, 2048, 4096)])
def test_packing_against_brute_force(spark, folder, sizes, shard_pieces):
    docs = documents(spark).select("doc_id", "text")
    if sizes == (512, 1024, 2048, 4096):
        docs = docs.union(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    else:
        docs = docs.where("length(text) < 100000 OR text IS NULL")
    rows = packing.best_fit_packing(docs, sizes=sizes, shard_pieces=shard_pieces).collect()
    texts = [r.text for r in docs.collect()]
    pieces_ = Counter(n for t in texts for n in [max(sizes)] * (len(words(t)) // max(sizes)) + [len(words(t)) % max(sizes)] if n)
    assert Counter(r.n_words for r in rows if r.n_words) == pieces_
    assert sum(r.n_words == 0 for r in rows) == sum(not words(t) for t in texts)
    shards = {}
    for r in rows:
        if r.n_words:
            shards.setdefault(r.bin_id >> 32, {}).setdefault(r.bin_id, []).append((r.bin_offset, r.n_words, r.bin_size))
    for bins in shards.values():
        got = Counter()
        for held in bins.values():
            held.sort()
            assert [o for o, _, _ in held] == [sum(n for _, n, _ in held[:i]) for i in range(len(held))]
            got[held[0][2], tuple(n for _, n, _ in held)] += 1
        assert got == packed_by_hand([n for held in bins.values() for _, n, _ in held], sizes, packing.OVERHEAD)


# ---- licence wording does not depend on line breaks

def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n[ \t\r]*\n", text))


PUBLISHED = {"MIT": licenses.KNOWN["MIT"][0].replace("MIT License\n", "MIT License\n\nCopyright (c) 2019-2023 A very long name of a holder, with co-workers, contributors and their employers in several places\n"),
             "ISC": "Copyright 2004 B (b@example.org)\n\n" + licenses.KNOWN["ISC"][0]}


def published():
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    return PUBLISHED | {names[f.name]: f.read_text(encoding="utf8") for f in sorted(folder.glob("*")) if f.name in names and not f.is_symlink()}


def test_licenses_are_found_however_they_are_wrapped(spark):
    texts = [(name, wrapped(text, width)) for name, text in published().items() for width in (60, 64, 70, 72, 76, 78, 79, 80, 100, 120)]
    rows = [(2 * i, t, None) for i, (_, t) in enumerate(texts)] + [(2 * i + 1, f"A post about code.\n\n{t}\n\nMore of it follows.", None) for i, (_, t) in enumerate(texts)]
    got = licenses.license_scan(documents(spark, rows)).where("license_id IS NOT NULL AND unit IN ('text', 'block')").select("doc_id", "license_id").distinct().collect()
    found = {}
    for i, name in got:
        found.setdefault(i, set()).add(name)
    for i, (name, _) in enumerate(texts):
        assert name in found.get(2 * i, set()), (name, "whole")
        assert name in found.get(2 * i + 1, set()), (name, "inside")


def test_only_notices_are_left_out():
    for kept in ("(c) You must retain, in the Source form", "copyright license to reproduce", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM AND MORE WORDS THAN A NOTICE HAS", "the copyright owner"):
        assert licenses.canonical(kept).split()[:2] == [licenses.SPELLINGS.get(w, w) for w in re.findall(r"[^\W_]+", kept.lower())][:2]
    for gone in ("Copyright (c) 2020 Somebody", "(c) 1999 X", "© 2001 Y Inc.", "Copyright <YEAR> <HOLDER>", "Copyright 2012 A\nCopyright 2013 B. All rights reserved.", "All rights\nreserved.", "Copyright The Authors"):
        assert licenses.canonical(gone) == ""
    assert licenses.canonical("Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy") == "everyone is permitted to copy"
