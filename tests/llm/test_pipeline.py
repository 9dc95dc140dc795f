from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from odd import PASSAGE, ROWS, by_text, documents, words
from test_dedup import bare, exact_by_hand, print_by_hand

import corpus_pipeline as pipeline
from statloom.llm import language_id
from statloom.session import settle


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return settle(documents(spark))


def test_stages_are_named():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    assert pipeline.ORACLE_SQL is None


def test_language_stage_drops_what_has_no_letter(spark, odd):
    got = pipeline.language(spark, odd, "")
    assert got.columns == odd.columns
    kept = Counter(plain(got))
    for row in ROWS:
        if row[1] is None or not any(c.isalpha() for c in row[1]):
            assert kept[row[:2]] == 0
    assert kept[12, ROWS[12][1]] == 1


def test_language_stage_without_labels(spark):
    rows = [(i, t, None) for i, t, _ in ROWS]
    got = Counter(plain(pipeline.language(spark, documents(spark, rows), "")))
    assert got == Counter((i, t) for i, t, _ in ROWS if t is not None and any(c.isalpha() for c in t))


def test_language_stage_keeps_a_label_named_und(spark):
    rows = [(1, "le renard brun saute", "fr"), (2, "xxyy zzqq wwkk", "und"), (3, "12 34", "und")]
    assert sorted(plain(pipeline.language(spark, documents(spark, rows), ""))) == [(1, rows[0][1]), (2, rows[1][1])]


def test_language_stage_drops_what_is_of_no_learned_language(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en"), (2, "le renard brun saute par-dessus le chien", "fr"), (3, "the brown dog", None),
            (4, "Съешь же ещё этих мягких булок", None), (5, "!", None), (6, "le chien brun, the dog: Съешь", None)]
    docs = documents(spark, rows)
    assert sorted(plain(pipeline.language(spark, docs, ""))) == [r[:2] for r in rows if r[0] in (1, 2, 3, 6)]
    got = {r.doc_id: r.reason for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: language_id.UNFAMILIAR, 5: language_id.NO_LETTER, 6: None}


def test_exact_stage(spark, odd):
    got = pipeline.exact(spark, odd, "")
    assert got.columns == odd.columns
    decisions = {(i, sha): kept for i, _, _, kept, sha in exact_by_hand(ROWS)}
    import hashlib
    want = {(i, t) for i, t, _ in ROWS if decisions[i, hashlib.sha256(bare(t).encode()).hexdigest()]}
    rows = plain(got)
    assert set(rows) == want and len(rows) == len({(i, bare(t)) for i, t in want})


def test_near_stage(spark, odd):
    got = pipeline.near(spark, odd, "")
    prints = [print_by_hand(t) for _, t, _ in ROWS]
    found = list(range(len(ROWS)))
    for _ in ROWS:
        for i, p in enumerate(prints):
            found[i] = min(found[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
    smallest = {}
    for i, (id_, *_) in enumerate(ROWS):
        if id_ is not None:
            smallest[found[i]] = min(id_, smallest.get(found[i], id_))
    want = [(id_, t) for i, (id_, t, _) in enumerate(ROWS) if id_ == smallest.get(found[i])]
    assert by_text(plain(got)) == by_text(want)


def test_substring_stage(spark, odd):
    got = {r.doc_id: r for r in pipeline.repeats(spark, odd, "").collect()}
    assert got[10].text == "other words in front and behind" and got[10].n_chars == len(got[10].text)
    assert got[11].text == "" and got[9].text == f"before {PASSAGE} after"
    assert got[2].text == ROWS[1][1] and got[4].text is None and got[4].n_chars is None


def test_packing_stage_packs_every_word(spark, odd):
    got = pipeline.pack(spark, odd, "").toPandas()
    assert got.n_words.sum() == sum(len(words(t)) for _, t, _ in ROWS)


def test_run_is_its_stages(spark, tmp_path):
    rows = [(i, f"{t} {i // 2}" if t and len(t) < 100 else t, lang) for i, (_, t, lang) in enumerate(r for r in ROWS if r[0] not in (12, 13))]
    ids, texts, langs = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array(langs), "source": pa.array(langs),
                             "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)))
    key = ["doc_id", "piece", "start", "n_words"]
    assert by_text(map(tuple, pipeline.run(spark, str(tmp_path)).select(key).collect())) == by_text(map(tuple, docs.select(key).collect()))


def test_empty_documents(spark):
    docs = documents(spark, [])
    for name, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, ""))
        assert docs.collect() == [], name
