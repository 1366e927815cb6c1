"""Language ID, PII, secrets, decontamination and token counts against brute force on small tables."""

import hashlib
import re
import tracemalloc

import numpy as np
import pytest

from spendscope.llm import decontaminate, language_id, pii, secrets, token_counts


def spelled(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


# -- language ----------------------------------------------------------------------------------------


def test_language_on_held_out_rows(documents):
    guessed = language_id.predict(documents, language_id.fit(documents)).toPandas()
    both = guessed.merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert len(guessed) == documents.count() and len(held) > 30
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert guessed["score"].between(0, 1).all()


def test_language_of_odd_texts(odd, nothing):
    model = language_id.fit(odd)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert language_id.predict(odd, model).count() == odd.count()
    for i in (3, 4, 5, 13):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[6]["lang_pred"] in ("xx", "yy")
    assert language_id.predict(nothing, model).count() == 0
    unlearned = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, unlearned).collect()} == {"und"}
    kept = language_id.keep_known(odd, model)
    assert kept.schema == odd.schema and {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5, 13})


def test_filter_finds_all_languages_of_an_ngram_and_corrects_chance():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    masks = np.zeros((3000, 2), np.uint64)
    masks[:, 0] = rng.integers(1, 16, 3000)
    masks[::7, 1] = 1 << 5
    names = [f"l{i}" for i in range(70)]
    model = language_id.LanguageFilter.of(names, keys, masks)
    held = None
    for at in model._places(keys):
        held = model.cells[at] if held is None else held & model.cells[at]
    assert (held & masks == masks).all()  # no language is ever missed
    other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    seen = None
    for at in model._places(other):
        seen = model.cells[at] if seen is None else seen & model.cells[at]
    assert abs((seen[:, 0] & np.uint64(1)).mean() - model.by_chance()[0]) < 0.002


def test_grams_of_many_texts_are_those_of_each():
    texts = ["ab, cd!", None, "", "x", "é" * 5, "a  -  b", "1 2", "q\0r"]
    keys, bounds = language_id.grams(texts)
    for k, t in enumerate(texts):
        alone, _ = language_id.grams([t])
        assert (keys[bounds[k] : bounds[k + 1]] == alone).all() and bounds[k + 1] - bounds[k] == len(alone)


def test_a_batch_is_judged_in_blocks_of_bounded_memory():
    texts = ["the old house by a river was quiet " * 500] * 200  # 3.5 million code points
    keys = np.unique(language_id.grams(texts[:1])[0])
    model = language_id.LanguageFilter.of(["xx"], keys, np.ones((len(keys), 1), np.uint64))
    tracemalloc.start()
    languages, _, cover = language_id.guesses(model, [*texts, None, "12"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert languages == ["xx"] * 200 + ["und"] * 2 and (cover[:200] == 1).all()
    assert peak < 30 << 20


def test_texts_of_a_language_of_thousands_of_characters_are_known(spark):
    rng = np.random.default_rng(4)
    signs = [chr(0x4E00 + k) for k in range(4000)]
    common = ["".join(rng.choice(signs, 3)) for _ in range(60)]
    rare = lambda n: "".join(rng.choice(signs, n))
    wide = [rare(30) + "".join(rng.choice(common, 2)) + rare(30) for _ in range(900)]
    words = "the old house by a river was quiet and nobody came there after rain had fallen on stone".split()
    narrow = [" ".join(rng.choice(words, 30)) for _ in range(900)]
    other = ["".join(chr(0x430 + k) for k in rng.integers(0, 32, 60)) for _ in range(50)]
    rows = [(i, t, "zz") for i, t in enumerate(wide)] + [(1000 + i, t, "nn") for i, t in enumerate(narrow)] + [(2000 + i, t, None) for i, t in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    guessed = language_id.predict(docs, model).filter("held_out and doc_id < 1000").toPandas()
    right = set(guessed[guessed["lang_pred"] == "zz"]["doc_id"])
    assert len(right) > 0.95 * len(guessed) and guessed["cover"].median() < language_id.LEAST_COVER
    kept = {r["doc_id"] for r in language_id.keep_known(docs, model).collect()}
    assert len(right & kept) > 0.98 * len(right)
    assert kept >= set(range(1000, 1900)) and not any(i >= 2000 for i in kept)
    least = dict(zip(model.languages, model.least))
    assert least["nn"] == language_id.LEAST_COVER and 0 < least["zz"] < 0.1


def test_a_row_is_judged_by_the_other_rows():
    keys = np.array([5, 5, 6, 7, 9], np.uint64)
    known, n, top = np.array([5, 6, 7], np.uint64), np.array([2, 3, 1]), np.full(3, 0.01)
    assert language_id.cover_by_others(keys, known, n, top, 100) == 1 / 5  # only 6 is left without this row
    assert language_id.cover_by_others(keys, known, n, top, 5) == 0


# -- personal data -----------------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y x@y.z. .a@b.co-m.uk@z.q", "%a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.1 1.2.3.4.", "999.1.2.3.4",
    "4532 0151-1283 0366 4532015112830366 45320151128303661234567 1-2-3 4", "+1 (234) 567-8901 +12-3 ++1234567890 +1 2345678901234567",
    "é語 mail@x.org 語 +49 (30) 1234-567 é", "11-22 33", "a@b" * 5, "@ + 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
]


def test_base_spans_are_those_of_the_plain_patterns(spark, odd, documents):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(extra).union(documents.selectExpr("doc_id + 1000", "text"))
    texts = docs.distinct().collect()
    got = pii.report(docs).toPandas()
    assert len(got) == docs.count()
    got = got.drop_duplicates().set_index("doc_id")
    for r in texts:
        spans = base_of(r["text"])
        row = got.loc[r["doc_id"]] if r["doc_id"] is not None else got[got.index.isna()].iloc[0]
        assert row["base_sha256"] == hashlib.sha256(spelled(spans, pii.KINDS).encode()).hexdigest(), r["text"][:200]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert set(filter(None, spelled(spans, pii.KINDS).split(","))) <= set(row["spans"].split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words here, phone: +1 (234) 567-{1000 + i} and so on") for i in range(30)]
    rows += [(100 + i, f"other words; phone: 555-{1000 + i}, thanks") for i in range(5)]
    rows += [(200 + i, f"it cost {1000 + i} coins and the year was {1900 + i}.") for i in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)[103]
    at = text.index("555-1003")
    assert got[103] == f"phone:{at}:{at + 8}"
    assert all(got[200 + i] == "" for i in range(30))


def test_many_matches_in_one_text(spark):
    text = "é " + " ".join(f"u{i}@h{i}.org" for i in range(1500))
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_email"] == 1500 and got["spans"] == spelled([(m.start(), 0, m.end()) for m in re.finditer(PII["email"], text)], pii.KINDS)


def test_redaction(spark, odd, nothing):
    out = pii.redact(odd)
    assert out.schema.names == odd.schema.names and out.count() == odd.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[14].endswith(" mail [EMAIL]. [PHONE] and [IP]") and text[3] is None and text[4] == ""
    number = next(n for d in range(10) if luhn(n := f"45320151128303{d}"))  # a card number that is a phone number too
    overlap = spark.createDataFrame([(1, f"x +{number} y é"), (2, f"x {number}, 10.0.0.1 é")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(overlap).orderBy("doc_id").collect()] == ["x [PHONE] y é", "x [CARD], [IP] é"]
    assert pii.redact(nothing).count() == 0 and pii.report(nothing).count() == 0


# -- secrets -----------------------------------------------------------------------------------------


def secret_base(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_secret_base_spans(spark, odd, documents, nothing):
    tricky = ["API_KEY='abcdefgh' apikey:x apikey=12345678", "AKIA AKIA1 AKIAAKIAAKIAAKIA9", "deadbeef" * 5 + "g" + "0" * 31, "toKen \"= 'Zz-zz.zz=", "ſecret=12345678 toKen=12345678"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    docs = docs.union(documents.selectExpr("doc_id + 1000", "text"))
    got = secrets.scan(docs, secrets.fit(docs)).toPandas()
    assert len(got) == docs.count()
    got = got.drop_duplicates().set_index("doc_id")
    for r in docs.distinct().collect():
        if r["doc_id"] is not None:
            spans = secret_base(r["text"])
            row = got.loc[r["doc_id"]]
            assert row["base_sha256"] == hashlib.sha256(spelled(spans, secrets.KINDS).encode()).hexdigest()
            assert [row[f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(x[1] == k for x in spans) for k in range(3)]
            assert set(filter(None, spelled(spans, secrets.KINDS).split(","))) <= set(row["spans"].split(","))
    assert secrets.scan(nothing, secrets.fit(nothing)).count() == 0


def test_models_tell_random_strings_from_identifiers(spark):
    rng = np.random.default_rng(3)
    key = lambda: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghijkmnpqrstuvwxyz"), 24))
    words = "customer account number retrieve context application handler buffer session manager index column latency window".split()
    name = lambda: "_".join(rng.choice(words, 3)) if rng.random() < 0.5 else "".join(str(w).title() for w in rng.choice(words, 3))
    rows = [(i, f"set password={key()} for {name()} and {name()}") for i in range(200)]
    unseen = key()
    rows.append((999, f"the value {unseen} was found by retrieve_customer_accounts yesterday"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.fit(docs)).collect()}
    assert got[999] == f"random:10:{10 + len(unseen)}"
    assert all(":" in got[i] and "random" not in got[i] for i in range(200))


# -- decontamination ---------------------------------------------------------------------------------


def test_whole_items_are_found_and_clean_documents_left(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents, items).collect()}
    texts, tests = documents.collect(), items.collect()
    assert found == {(d["doc_id"], i["item_id"]) for d in texts for i in tests if i["text"] in (d["text"] or "")}
    kept = decontaminate.keep_clean(documents, items)
    assert kept.schema == documents.schema and {r["doc_id"] for r in kept.collect()} == {d["doc_id"] for d in texts} - {d for d, _ in found}


def test_retrieval_is_exact(documents):
    rng = np.random.default_rng(1)
    units = [decontaminate.Unit(i, rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64), (np.zeros(0),) * 3) for i in range(100)]
    index = decontaminate.ImpactIndex(units)
    for _ in range(200):
        terms = np.unique(index.term_numbers(rng.integers(0, 300, 60).astype(np.uint64)))
        terms = terms[terms >= 0]
        score = np.zeros(100)
        for t in terms:
            p = slice(index.first[t], index.first[t + 1])
            score[index.unit[p]] += index.impact[p]
        passage, unit, found = index.retrieve(np.concatenate([np.zeros(len(terms), np.int64), np.ones(1, np.int64)]), np.append(terms, terms[:1]), 2, 0.3)
        got = dict(zip(unit[passage == 0].tolist(), found[passage == 0].tolist()))
        assert set(got) == set(np.flatnonzero(score >= 0.3 - 1e-12)) and all(abs(score[u] - s) < 1e-9 for u, s in got.items())
    own = np.unique(index.term_numbers(units[7].words))
    assert 7 in index.retrieve(np.zeros(len(own), np.int64), own, 1, 0.99)[1]


def test_a_question_without_its_answer_is_found(spark):
    question = "what did the quick brown fox see when it jumped over the lazy old dog?"
    answer = " ".join(f"answer{k}" for k in range(40)) + "."
    items = spark.createDataFrame([(1, f"{question} {answer}"), (2, f"why not? {answer}")], "item_id long, text string")
    other = " ".join(f"other{k}" for k in range(100))
    rows = [(0, f"{other} {question} {other}"), (1, f"{other} why not? {other}"), (2, f"{other} what did the quick brown fox see {other}"), (3, other), (4, f"{other} {question} {answer}")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(0, 1), (4, 1)}
    assert {r["doc_id"] for r in found} == {0, 4}
    assert next(r["question_overlap"] for r in found if r["doc_id"] == 0) == 1.0


def test_decontamination_of_odd_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "One question here? The answer"), (3, "two words")], "item_id long, text string")
    assert decontaminate.contaminated(odd, none).count() == 0
    assert decontaminate.keep_clean(odd, none).count() == odd.count()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()}
    assert {(7, 3), (8, 3)} <= got and all(i == 3 for _, i in got)
    assert decontaminate.contaminated(nothing, items).count() == 0
    docs = spark.createDataFrame([(1, "xx yy zz " * 500 + "One QUESTION here?? the answer " + "ww vv " * 900)], "doc_id long, text string")
    row = decontaminate.contaminated(docs, items).filter("item_id = 4").first()
    assert row["question_overlap"] == 1 and row["overlap"] == 1
    many = decontaminate.indexes(items, units=2)
    assert sum(len(i.units) for i in many) == 3


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    tests = [" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(2, 90)) % 500) for _ in range(60)] + [None, ""]
    items = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(tests)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(tests)], "doc_id long, text string")
    whole = [u for i, t in enumerate(tests) for u in decontaminate.units_of(i if i % 9 else None, t)]
    plain = decontaminate.ImpactIndex(whole)
    impacts = lambda index: sorted((index.units[u].words.tobytes(), round(x, 9)) for u, x in zip(index.unit, index.impact))
    parts = list(decontaminate.indexes(items, units=20))
    assert len(parts) > 3 and sorted(x for p in parts for x in impacts(p)) == impacts(plain)
    found = lambda: sorted((r["doc_id"], r["item_id"] or 0, round(r["score"], 9), r["overlap"]) for r in decontaminate.contaminated(docs, items).collect())
    one, clean = found(), sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect())
    assert {d for d, *_ in one} == set(range(60)) and clean == [60, 61]
    several = decontaminate.indexes
    monkeypatch.setattr(decontaminate, "indexes", lambda items: several(items, units=60))
    # items without an id are one item in an index, so their rows are compared as a set of documents
    assert [r for r in found() if r[1]] == [r for r in one if r[1]] and {r[0] for r in found()} == {r[0] for r in one}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()) == clean


@pytest.mark.parametrize("n", [65, 66, 67, 70, 129])
def test_the_rest_of_a_long_item_is_no_unit_of_its_own(spark, n):
    item = [f"i{k}" for k in range(n)]
    rest = item[n // 64 * 64 :]
    texts = [f"a clean text about {' '.join(rest)} and more", " ".join(rest), "before it " + " ".join(item) + " after", "x " * 100 + " ".join(item[-64:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["overlap"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {2: 1.0, 3: 1.0}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()} == {0, 1}
    assert {len(u.words) for u in decontaminate.units_of(1, " ".join(item))} == {64}


# -- token counts ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer, models, normalizers

    def build(pieces):
        t = Tokenizer(models.Unigram(pieces, 0, True))
        t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0

    return build


def test_counts_are_the_tokenizers(exact, odd, documents, nothing):
    count = exact(token_counts.vocabulary())
    for docs in (odd.filter("doc_id is not null and doc_id <> 9"), documents.filter("doc_id < 120")):
        want = {r["doc_id"]: count((r["text"] or "").replace("퟿", "퟿")) for r in docs.collect()}
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == want
    assert token_counts.token_counts(nothing).count() == 0


def test_ties_follow_the_tokenizer(exact):
    rng = np.random.default_rng(2)
    for scores in ([-1.0, -2.0, -3.0], [-1.5, -2.25]):
        pieces = {"<unk>": 0.0} | {f"<0x{b:02X}>": -50.0 for b in range(256)}
        pieces |= {"".join(rng.choice(list("ab▁"), rng.integers(1, 5))): float(rng.choice(scores)) for _ in range(25)}
        count, own = exact(list(pieces.items())), token_counts.PieceCounter(list(pieces.items()))
        for _ in range(400):
            text = "".join(rng.choice(list("aab cé\n"), rng.integers(0, 14)))
            assert own.tokens(text) == count(text), (text, pieces)
