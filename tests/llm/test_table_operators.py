"""Packing, token files, the Jaccard join and the vector join against brute force on small tables."""

import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spendscope.llm import jaccard_join, packing, token_files, tokens, vector_join
from spendscope.llm.components import components
from tests.llm.conftest import prose

# -- token ids ---------------------------------------------------------------------------------------


def test_memo_gives_the_tokenizers_ids(documents):
    encoder, rng = tokens.encoder(), random.Random(1)
    alphabet = [*"ab1.,'\n\t  é\r<| 　\x1c\x85s_³́#!", "'s", "<|endoftext|>", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    texts += [r["text"] or "" for r in documents.collect()]
    assert all(encoder.ids(t) == encoder.plain(t) for t in texts)


def encoded(docs, end):
    encoder = tokens.encoder()
    return [(r["doc_id"], encoder.plain(r["text"] or "") + end.to_bytes(4, "little")) for r in docs.collect()]


# -- packing -----------------------------------------------------------------------------------------


def test_tournament_tree_is_first_fit():
    rng = random.Random(3)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, want = [], []
        for n in lengths:
            k = next((i for i, used in enumerate(bins) if used + n <= 50), len(bins))
            bins += [0] * (k == len(bins))
            want.append((k, bins[k]))
            bins[k] += n
        assert packing.first_fit_decreasing(lengths, 50) == want


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing_keeps_every_id_once(request, table):
    docs = request.getfixturevalue(table)
    got = packing.pack(docs, group_pieces=100).toPandas()
    whole = sorted((-1 if i is None else i, ids) for i, ids in encoded(docs, packing.END_ID))
    want = sorted((i, s, len(p) // 4, zlib.crc32(p), len(ids) // 4) for i, ids in whole for s in range(0, len(ids) // 4, 2048) for p in [ids[4 * s : 4 * s + 8192]])
    rows = got.fillna({"doc_id": -1})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(int)
    assert sorted(map(tuple, rows.to_numpy().tolist())) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# -- token files -------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_token_files_round_trip(request, table):
    docs = request.getfixturevalue(table)
    manifest = token_files.write_token_files(docs)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect())
    rows = sorted(encoded(docs.orderBy("doc_id", "text"), token_files.END_ID), key=lambda x: -1 if x[0] is None else x[0])
    at, want = 0, []
    for doc_id, ids in rows:
        want.append((at, doc_id, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    total = b"".join(ids for _, ids in rows)
    stored = []
    for part in manifest.orderBy("part").collect():
        reader = token_files.SequenceReader(part["path"] + ".arrow")
        n = sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))
        for i in range(n):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == token_files.SEQUENCE
            stored.append(ids[np.array(mask)])
    assert np.concatenate(stored).astype("<u4").tobytes() == total


def test_sequences_are_views_of_the_mapped_file(documents):
    part = token_files.write_token_files(documents).first()
    reader = token_files.SequenceReader(part["path"] + ".arrow")
    ids, _ = reader.sequence(0)
    whole = reader.file.get_batch(0).column(0).flatten().to_numpy()
    assert not ids.flags.owndata and ids.ctypes.data == whole.ctypes.data


def test_no_token_files_of_nothing(nothing):
    manifest = token_files.write_token_files(nothing)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


# -- components --------------------------------------------------------------------------------------


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    nodes = {x for l in links for x in l}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(nodes, links)
    assert {n: got.get(n, n) for n in nodes} == want


# -- Jaccard join ------------------------------------------------------------------------------------


def shingles(text, k):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k, percent):
    sets = defaultdict(set)
    for i, text in rows:
        sets[i].add(shingles(text, k))
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    links = []
    for x, (a, s) in enumerate(flat):
        for b, t in flat[x + 1 :]:
            n = len(s & t)
            if 100 * n >= percent * (len(s) + len(t) - n):
                links.append((a, b))
    return roots(sets, links), sets


def corpus(seed):
    """Groups of near copies of all degrees, passages that many texts share, short texts, chains."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 40).split(" ")
    for g in range(25):
        base = prose(rng, rng.choice([3, 6, 25, 90, 160])).split(" ")
        for _ in range(rng.choice([1, 2, 5, 14])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append(" ".join(own + passage if g % 3 == 0 else own))
            base = own if g % 5 == 0 else base
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2), (3, 60, 3)])
def test_jaccard_groups(spark, k, percent, seed):
    rows = corpus(seed)
    want, sets = brute_groups(rows, k, percent)
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(next(iter(s))) for i, s in sets.items()}
    assert 1 < len(set(want.values())) < len(rows)


def test_jaccard_of_odd_tables(odd, nothing):
    got = jaccard_join.similar_groups(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5)
    assert by_id[1][1] == by_id[2][1] == 0 and by_id[7] == (1, 7) and by_id[8] == (1, 7)
    assert jaccard_join.similar_groups(nothing).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_texts_that_share_a_doc_id_are_each_linked(spark, order):
    rng = random.Random(8)
    long, short = prose(rng, 900), prose(rng, 60)
    near = lambda text: text + " " + prose(rng, 3)
    rows = [(5, short), (5, long), (9, near(long)), (2, near(short)), (5, "quite another text of a few words"), (7, prose(rng, 60))]
    rows = [*rows, *((k, prose(rng, 80)) for k in range(20, 60))][::order]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_groups(docs).collect()}
    assert {c for d, c in got if d in (2, 9)} == {2} and (5, 2) in got and (7, 7) in got
    assert all(d == c for d, c in got if d >= 20)


def test_prefixes():
    s = np.arange(100, dtype=np.uint64)
    none = np.zeros(0, np.uint64)
    plain = jaccard_join.prefix_of(s, 85, jaccard_join.Order(none, np.zeros(0, np.int64)))
    assert 1 < plain[0] <= jaccard_join.MOST_MATCHES and plain[1].tolist() == list(range(15 + plain[0]))
    often = jaccard_join.prefix_of(s, 85, jaccard_join.Order(s[3:6], np.full(3, 10**6)))
    assert set(range(3, 6)).isdisjoint(often[1].tolist())  # frequent shingles come last
    costly = jaccard_join.prefix_of(s, 85, jaccard_join.Order(s[16:], np.arange(100, 184)))
    assert costly[0] < plain[0] or costly[0] == jaccard_join.MOST_MATCHES  # length goes by the estimated cost
    nothing = jaccard_join.SharedFilter(4, {})
    alone = jaccard_join.prefix_of(s, 85, jaccard_join.Order(none, np.zeros(0, np.int64), nothing))
    assert alone[0] == 1 and not len(alone[1])  # shingles of one document are never sent


# -- vectors -----------------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.95):
    use = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            use[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(i, j) for i in use for j in use if i < j and len(use[i]) == len(use[j]) and use[i] @ use[j] >= cosine]
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = roots({i for i, _ in rows}, [(rows[i][0], rows[j][0]) for i, j in links])
    return sorted((i, n[k], root[i], i == root[i]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("dims, chunk", [(64, 4096), (64, 16), (3, 4096), (1, 8)])
def test_vector_join(spark, monkeypatch, dims, chunk):
    monkeypatch.setattr(vector_join, "CHUNK", chunk)
    rng = np.random.default_rng(dims + chunk)
    rows, f32 = [], lambda v: [float(x) for x in np.float32(v)]
    for g in range(30):
        v = rng.standard_normal(dims)
        for _ in range([1, 1, 2, 6, 20][g % 5]):
            rows.append(f32(v + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.2, 0.3])))
    rows = [(i, v) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, rows[3][1]), (n + 1, f32(2 * np.array(rows[3][1]))), (n + 2, None), (n + 3, [0.0] * dims), (n + 4, [1.0] * (dims + 1)), (n + 5, []), (3, rows[3][1])]
    rows += [(n + 6, [float("nan")] * dims), (n + 7, [float("inf")] + [1.0] * (dims - 1)), (n + 8, [None] + [1.0] * (dims - 1))]
    table = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_duplicates(table).collect())
    assert got == brute_vectors(rows)
    assert sum(x[1] for x in got) > 50


def test_vector_join_of_nothing(spark):
    assert vector_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def side(rng, n, dims=8, apart=0.01):
    raw = np.float32(np.ones(dims) + apart * rng.standard_normal((n, dims)))
    rows = {"node": np.arange(n), "copies": rng.integers(1, 4, n), "vec": [r.tobytes() for r in raw]}
    return vector_join._Side(vector_join.pa.table(rows), "<f4")


def test_links_of_near_copies_are_not_held_as_pairs(monkeypatch):
    monkeypatch.setattr(vector_join, "TILE", 1 << 16)
    monkeypatch.setattr(vector_join, "WHOLE", 1 << 16, raising=False)
    one, other = side(np.random.default_rng(1), 1500), side(np.random.default_rng(2), 1500)
    tracemalloc.start()
    got = vector_join.links(one, other, 0, 0.95, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the pairs would take 54 MB
    assert (got.count[:1500] == one.copies.sum() - one.copies + other.copies.sum()).all()
    assert (got.count[1500:] == one.copies.sum()).all() and (got.label == 0).all()


def test_running_union_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    for n_pairs in (20, 60, 150):
        p, q = rng.integers(0, 100, (2, n_pairs))
        got = vector_join._Links(np.ones(100, np.int64))
        for at in range(0, n_pairs, 7):
            got.add(p[at : at + 7], q[at : at + 7])
        want = roots(set(range(100)), list(zip(p.tolist(), q.tolist())))
        assert got.label.tolist() == [want[k] for k in range(100)]
        assert got.count.tolist() == (np.bincount(p, minlength=100) + np.bincount(q, minlength=100)).tolist()


def test_chunks_go_by_the_bytes_of_vectors(spark):
    cells = spark.createDataFrame([("64:0,0", 32768), ("64:0,0", 32769), ("768:0,0", 32768), ("768:1,-1", 100)], "cell string, size long")
    assert [r[0] for r in cells.select(vector_join.chunks("<f4")).collect()] == [1, 2, 6, 1]
    assert [r[0] for r in cells.select(vector_join.chunks("<f8")).collect()] == [1, 2, 12, 1]


def test_vector_join_of_cells_split_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = [[float(x) for x in np.float32(np.ones(64) + rng.standard_normal(64) * s)] for s in rng.choice([0.02, 0.3], 120)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_join, "CHUNK_BYTES", 5000)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_duplicates(table).collect())
    assert got == brute_vectors(list(enumerate(vectors)))
