"""Ranked search, BPE and spelling variants against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spendscope.llm import bpe_automaton, lexical_search, spelling
from spendscope.llm import queries as registry

CLASH = "doc_id long, text string, item long, block long, word string, n long, ids string, rank int, key string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, 7, "w", 7, "x", 7, "k") for i, t in rows], CLASH).repartition(parts)


# -- ranked search -----------------------------------------------------------------------------------


def ranked(docs, items, first=50):
    """Scores of the contract, a term and a document at a time."""
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts = [(i, Counter(term.findall(low(t)))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(x for _, c in counts for x in c)
    asked = {}
    for i, t in items:
        if i is not None and term.findall(low(t)):
            asked.setdefault(i, set()).update(term.findall(low(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, c in counts:
            if doc_id is None or not c:
                continue
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in w)
            if s > 0:
                scores.append((-s, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:first], 1)]
    return sorted(out)


def lexicon(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "x", "É1", "it's", "日本", "a_b"] + ["".join(rng.choice("abcdeé9") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 8, 40, 200]))) for i in range(n)]
    docs += [(n + i, "the of") for i in range(120)] + [(3, "the of x"), (None, "the rarest x"), (n + 500, None), (n + 501, "..!"), (n + 502, "of " * 50_000 + "rarest")]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(12)] + [(90, "the of"), (91, None), (92, "?!"), (None, "the"), (93, "nowhere-else"), (90, "rarest"), (90, "rarest")]
    return docs, items


@pytest.mark.parametrize("seed, shares, part_terms", [(1, lexical_search.OWNER_SHARES, 1_000_000), (2, (0.05,), 60), (3, (), 1_000_000)])
def test_search_against_brute_force(spark, seed, shares, part_terms):
    docs, items = lexicon(seed, 400)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, term long")
    got = lexical_search.search(table(spark, docs, 7), asked, shares=shares, part_terms=part_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == ranked(docs, items)
    few = lexical_search.search(table(spark, docs, 2), asked, first=3, shares=shares, part_terms=part_terms)
    assert sorted(tuple(r) for r in few.collect()) == ranked(docs, items, 3)


def test_stages_drop_what_cannot_reach_the_first(spark):
    """Sums that can't reach the 50th leave the bundles; nothing else does."""
    docs = [(i, "common " * (1 + i % 3) + ("rare" if i < 60 else "plain")) for i in range(5000)]
    items = [(1, "common rare")]
    got = lexical_search.search(table(spark, docs, 9), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == ranked(docs, items)
    assert all(r["doc_id"] < 60 for r in got)


def test_search_in_odd_and_empty_tables(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, rows[0][1]), (2, "word AKIA token")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in lexical_search.search(odd, asked).collect()) == ranked(rows, items)
    assert lexical_search.search(nothing, asked).count() == 0
    assert lexical_search.search(odd, asked.limit(0)).count() == 0
    assert lexical_search.search(odd.filter("text is null"), asked).count() == 0


# -- BPE ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return bpe_automaton.vocabulary()


def same_as_library(v, text):
    theirs = v.tokenizer.encode(text, add_special_tokens=False).ids
    ours = np.frombuffer(v.encode(text), "<i4").tolist()
    return ours == theirs and v.decode(ours) == v.tokenizer.decode(theirs, skip_special_tokens=False)


def test_ids_and_labels_are_the_librarys(words):
    rng = random.Random(3)
    signs = list("abcdeeeiiinnnttthhh   \n'sSTΣσß0123.,!?éÉ\t　 ́ \x1c\x1f\x85\x00İǅŉ中文🙂<|>ﬁé") + ["'ll", "'S", "<|endoftext|>", "<|startoftext|>", "</w>"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert same_as_library(words, text), repr(text)
    for text in ("a" * 7000, "ha" * 3000, "ll" * 501, "é" * 2001, "!" * 3000, "the" * 900, "x" * 100 + "İ."):
        assert same_as_library(words, text)


def test_memo_is_bounded_and_does_not_change_ids(words, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(bpe_automaton, "ARC_ENTRIES", 20)
    fresh = bpe_automaton.Vocabulary(__import__("public_tokenizers").path(bpe_automaton.TOKENIZER_FILE))
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(30))
        assert same_as_library(fresh, text)
    assert len(fresh.memo) <= 6 and len(fresh.arcs) <= 21


def by_rank(word, merges):
    """Merges in order of rank, each from left to right."""
    parts = list(word)
    for a, b in merges:
        out = []
        for x in parts:
            if out and out[-1] == a and x == b:
                out[-1] = a + b
                out.append(None)  # a merged pair is no part of the same merge again
            else:
                out.append(x)
        parts = [x for x in out if x is not None]
    return parts


def test_automaton_accepts_just_the_merged_sequence():
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("ab"), []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        automaton = bpe_automaton.TokenAutomaton(list("ab"), merges)
        assert len(automaton.owner) <= len(merges) + 1  # a state for each merge at most
        for _ in range(20):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
            ways = [[]]
            accepted = []
            while ways:
                way = ways.pop()
                at = sum(map(len, way))
                if at == len(word):
                    accepted.append(way)
                state = automaton.enters[way[-1]] if way else 0
                ways += [way + [t] for t in automaton.enters if word.startswith(t, at) and automaton.has(state, t)]
            assert accepted == [by_rank(word, merges)]


def test_merge_lists_out_of_order_are_refused():
    with pytest.raises(ValueError, match="comes before its parts"):
        bpe_automaton.TokenAutomaton(list("abc"), [("ab", "c"), ("a", "b")])


def test_encode_and_decode_tables(spark, odd, nothing, words):
    rows = odd.select("doc_id", "text").collect()
    encoded = {(r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in bpe_automaton.encode(odd).collect()}
    lib = lambda t: None if t is None else tuple(words.tokenizer.encode(t, add_special_tokens=False).ids)
    assert encoded == {(r["doc_id"], lib(r["text"])) for r in rows}
    decoded = bpe_automaton.decode(bpe_automaton.encode(odd)).collect()
    assert all(r["decoded"] == (None if r["ids"] is None else words.tokenizer.decode(r["ids"], skip_special_tokens=False)) for r in decoded)
    got = sorted((str(r["doc_id"]), *r[1:]) for r in bpe_automaton.digests(odd).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [(str(r["doc_id"]), lib(r["text"] or "")) for r in rows]
    assert got == sorted((i, len(x), sha(" ".join(map(str, x))), sha(words.tokenizer.decode(list(x), skip_special_tokens=False))) for i, x in ids)
    assert bpe_automaton.digests(nothing).count() == 0


# -- spelling ----------------------------------------------------------------------------------------


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :])

    near_to = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {w: min(x, key=lambda y: (-counts[y], y)) for w, x in near_to.items() if x}
    form = {w: f for w, f in form.items() if counts[f] >= 10 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near_to[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=str)


def misspelt(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿé") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    words += ["ababababab", "aaaaaaaa", "abababababab", "prefixed" + "x" * 30, "Straße" * 2, "unÿÿÿÿÿÿ"]
    rows = []
    for i in range(300):
        out = []
        for _ in range(rng.randint(0, 40)):
            w = words[min(int(rng.expovariate(0.15)), len(words) - 1)]
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "é", "É"]) + w[at + rng.randint(0, 1) :]
            out.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", "1", "_", "—", "×", "÷"]).join(out)))
    chain = "chainedup"  # counts 2, 20, 200: two steps to the root
    rows += [(1000, f"{chain}xx " * 2), (1001, f"{chain}x " * 20), (1002, f"{chain} " * 200), (1003, None), (1004, ""), (None, "nowhere nowhere"), (5, "repeated repeated"), (5, "repeated repeated")]
    return rows


@pytest.mark.parametrize("seed, group_bytes", [(1, spelling.GROUP_BYTES), (2, 30), (3, 1)])
def test_variants_against_brute_force(spark, monkeypatch, seed, group_bytes):
    monkeypatch.setattr(spelling, "SCAN_BYTES", 300)
    monkeypatch.setattr(spelling, "SCAN_PAIRS", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 100)
    rows = misspelt(seed)
    got = spelling.variants(table(spark, rows, 5), group_bytes=group_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute_variants(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert sum(1 for r in expected if r[1]) > 20 and any(r[1] and r[2] != r[1] for r in expected)


def test_a_group_of_many_alike_words_is_divided(spark):
    """All words share their first half and more, so the first division leaves one large group."""
    rng = random.Random(6)
    words = sorted({"sharedbeginning" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(700)})
    rows = [(i, f"{w} {w} {w}") for i, w in enumerate(words)]
    grouped = spelling.groups(spelling.word_counts(table(spark, rows)), group_bytes=200).groupBy("key", *spelling.PLACE).count().collect()
    assert all(r["count"] * (r["whole"] - r["head"] - r["tail"]) <= 200 or r["whole"] - r["head"] - r["tail"] <= 1 for r in grouped)
    got = spelling.variants(table(spark, rows), group_bytes=200)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_variants(rows)


def test_scan_finds_pairs_at_one_edit_only():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode() for _ in range(80)})
    group = np.zeros(len(words), np.int64)
    got = sorted((int(a), int(b)) for i, j in spelling.near_pairs(group, words) for a, b in zip(i, j))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    assert got == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if edits(a, b) == 1]


def test_variants_in_odd_and_empty_tables(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in spelling.variants(odd).collect()), key=str) == brute_variants(rows)
    assert spelling.variants(nothing).count() == 0


# -- the registered queries ---------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_registered_queries_on_the_smallest_tables(spark, documents, words):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    run = lambda name: registry.queries()[name](spark, SF).collect()
    assert sorted(tuple(r) for r in run("op11_lexical_search")) == ranked(docs, items)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lib = [(i, words.tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in docs]
    assert sorted(tuple(r) for r in run("op12_bpe_automaton")) == sorted((i, len(x), sha(" ".join(map(str, x))), sha(words.tokenizer.decode(x, skip_special_tokens=False))) for i, x in lib)
