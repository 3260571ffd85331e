"""Near-duplicate vectors, documents and passages against brute force; the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings as E
from tidemark.llm import near_documents as N
from tidemark.llm import passages as S
from tidemark.llm import queries as Q
from tidemark.llm.shingles import Batch, word_hashes


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Vectors ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [8192, 300])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16))
    x = np.concatenate([base, base[:150] + rng.normal(size=(150, 16)) * 0.25, base[:60], base[3:4].repeat(40, 0) + rng.normal(size=(40, 16)) * 0.05, base[5:6].repeat(30, 0) * 2])
    df = spark.createDataFrame([(i * 3, [float(v) for v in r], 1.5) for i, r in enumerate(x)], "vec_id long, embedding array<double>, n double")
    got = {r["vec_id"]: r for r in E.near_vectors(df, 0.9, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = components([(3 * a, 3 * b) for a, b in zip(*np.nonzero(links))], [3 * i for i in range(len(x))])
    assert len(got) == len(x)
    for i in range(len(x)):
        r = got[3 * i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[i].sum(), want[3 * i], want[3 * i] == 3 * i)


def test_vectors_of_blocks_that_split(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 8)  # blocks of 112: a block with itself splits four times
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(3, 8)), 300, 0) + rng.normal(size=(900, 8)) * 0.3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = components(zip(*(k.tolist() for k in np.nonzero(links))), range(len(x)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    assert got == {i: (links[i].sum(), want[i]) for i in range(len(x))}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [1e300, 1e290])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = E.near_vectors(df).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert by[1] == (3, 1) and by[2] == (3, 1) and by[10] == (3, 1)
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9)) and by[None] == (0, None)
    assert E.near_vectors(df.limit(0)).count() == 0 and E.near_vectors(df.where("vec_id = 3")).first()["kept"]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    base = {d: rng.normal(size=(40, d)) for d in (2, 3, 5)}
    rows = [(100 * d + k, (base[d][k % 40] + (k >= 40) * rng.normal(size=d) * 0.05).tolist(), d) for d in base for k in range(60)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, d int, v int, rep int, block int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    links, n = [], dict.fromkeys((i for i, _, _ in rows), 0)
    for i, v, d in rows:
        for j, w, e in rows:
            if i != j and d == e and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                links.append((i, j))
                n[i] += 1
    want = components(links, n)
    assert got == {i: (n[i], want[i]) for i in n} and all(any(n[100 * d + k] for k in range(60)) for d in base)


def test_vectors_that_no_near_block_holds(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 16)
    rng = np.random.default_rng(9)  # 40 clusters far apart: most pairs of blocks are provably distant
    x = np.repeat(rng.normal(size=(40, 6)), 30, 0) * 4 + rng.normal(size=(1200, 6)) * 0.4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in E.near_vectors(df).collect()}
    assert got == {i: links[i].sum() for i in range(len(x))}


# Documents -------------------------------------------------------------------------------------------------------------
def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, w, share):
    out = list(w)
    for _ in range(int(len(w) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"e{rng.randrange(9999)}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"e{rng.randrange(9999)}")
    return out


def test_edit_similarity_against_brute_force():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for k in range(80):
        a = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
        b = edited(rng, a, rng.choice([0.05, 0.15, 0.3])) if a and k % 4 else [f"v{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
        true = 1 - distance(a, b) / max(len(a), len(b), 1)
        got = N.edit_similarity(word_hashes(" ".join(a)), word_hashes(" ".join(b)))
        assert (got >= 0.8) == (true >= 0.8 - 1e-9)
        assert got <= true + 1e-9


def test_word_counts_bound_the_words_that_texts_share():
    rng = random.Random(6)
    texts = [[f"v{rng.randrange(v)}" for _ in range(n)] for v, n in ((3, 900), (3, 700), (40, 60), (900, 300), (900, 1), (1, 600), (50, 70)) for _ in range(3)]
    counts = N.word_counts(N.Batch([" ".join(t) for t in texts], N.GRAM))
    most = N.common_at_most(counts, counts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            shared = sum(min(a.count(w), b.count(w)) for w in set(a))
            longest = np.array([max(len(a), len(b))])
            assert most[i, j] >= shared
            assert N.counts_allow(counts[i : i + 1], counts[j : j + 1], longest, 0.8)[0] or shared < 0.8 * longest[0]


def test_entries_that_sketches_have_in_common():
    """As arrays' intersections have it, for short texts and long ones and pairs of both."""
    rng = random.Random(53)
    base = words(rng, 60)
    texts = [" ".join(base[: rng.choice([3, 8, 12, 20, 40, 60])] + words(rng, rng.randint(0, 3))) for _ in range(40)]
    which, key = N.sketch_keys(N.Batch(texts, N.GRAM))
    keys = [key[which == t].tolist() for t in range(len(texts))]
    rows, short = N.sketch_rows(keys)
    i, j = np.divmod(np.arange(1600), 40)
    got = N.entries_in_common(rows[i], rows[j], short[i] & short[j])
    assert 0 < short.sum() < 40 and got.tolist() == [len(set(keys[a]) & set(keys[b])) for a, b in zip(i, j)]


def test_pairs_of_tiles_agree_before_they_leave(spark):
    """Nodes of one bucket with equal word counts leave a tile only if their sketches agree."""
    sketch = lambda k: [1, *range(1000 * k, 1000 * k + N.ENTRIES - 1)]
    rows = [(7, k, k, 100, sketch(k // 2 + 1), bytes([1] * 100 + [0] * (N.CELLS - 100)), 40) for k in range(40)]
    members = spark.createDataFrame(rows, "key long, node long, root_node long, n_words long, keys array<long>, counts binary, size long")
    met = N._met(members, 64, N.SIMILAR)
    assert sorted((r["a"], r["b"]) for r in met.distinct().collect()) == [(k, k + 1) for k in range(0, 40, 2)]
    assert "hashpartitioning(tile#" in met._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_large_family_are_no_rows(documents, monkeypatch):
    """Of 200 texts that are nearly all just below the similarity, the pairs of large buckets are aligned in the tiles."""
    rng, rows, pairs, written = random.Random(61), [], [], N.written
    base = words(rng, 200)
    for i in range(200):
        w = list(base)
        for k in rng.sample(range(200), 25):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))

    def counted(df, name):
        df = written(df, name)
        pairs.append(df.count() if name == "pairs" else 0)
        return df

    monkeypatch.setattr(N, "written", counted)
    monkeypatch.setattr(N, "TILE", 64)
    assert N.near_documents(documents(rows)).count() == 200
    assert sum(pairs) <= 50 * len(rows)  # of 19,900


def test_texts_are_fetched_for_pairs_and_roots_for_nodes(documents, monkeypatch):
    """Documents that share a phrase and little else share entries, but few texts are fetched; a node of many large buckets
    is one row that roots and texts are joined to."""
    rng, phrase, tables, fetched = random.Random(67), words(random.Random(68), 8), {}, []
    family = words(rng, 80)
    rows = [(k, " ".join([*phrase, *words(rng, 30)])) for k in range(120)] + [(1000 + k, " ".join(edited(rng, family, 0.11))) for k in range(60)]
    written, written_texts = N.written, N.written_texts

    def kept(df, name):
        tables.setdefault(name, []).append(written(df, name))
        return tables[name][-1]

    def counted(rows, nodes):
        fetched.append(nodes.where("node < 1000").count())
        return written_texts(rows, nodes)

    monkeypatch.setattr(N, "written", kept)
    monkeypatch.setattr(N, "written_texts", counted)
    got = {r["doc_id"]: r["class_id"] for r in N.near_documents(documents(rows)).collect()}
    assert all(got[k] == k for k in range(120))
    sharing = tables["bucket-members"][0].where("node < 1000").select("node").distinct().count()
    assert sharing > 60 and max(fetched[:3]) < sharing / 2, (sharing, fetched)  # the fourth has those of mixed large buckets
    for table in tables["large-buckets"]:
        assert 0 < table.count() == table.select("node").distinct().count()


def test_tiles_meet_every_pair_once_in_rounds(spark):
    """Nodes of two buckets that are alike two by two, in tiles of eight; the rounds' links, put together, are all of them."""
    text = lambda k: " ".join(f"w{k // 2}x{i}" for i in range(40))
    rows = [(key, k, k, 40, [7, 8], N.word_counts(N.Batch([text(k)])).tobytes(), 64, 8, text(k)) for k in range(64) for key in (7, 8)]
    members = spark.createDataFrame(rows, "key long, node long, root_node long, n_words long, keys array<long>, counts binary, size long, tiles long, text string")
    rounds = [[(r["a"], r["b"]) for r in N._met(members, hubs, N.SIMILAR, met).collect()] for met, hubs in ((0, 4), (4, 16), (16, 64))]
    assert all(rounds) and sorted(sum(rounds, [])) == [(k, k + 1) for k in range(0, 64, 2)]


def test_near_documents_against_brute_force(documents):
    rng = random.Random(4)
    rows, base = [], [words(rng, rng.randrange(40, 400)) for _ in range(120)]
    common = words(rng, 60)
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w)))
        if i % 3 == 0:
            rows.append((10 * i + 1, " ".join(edited(rng, w, 0.02))))
        if i % 5 == 0:
            rows.append((10 * i + 2, "  ".join(w).upper()))
        if i % 4 == 0:
            rows.append((10 * i + 3, " ".join([*common, *words(rng, 200)])))
    hot = words(rng, 150)
    rows += [(5000 + k, " ".join(edited(rng, hot, 0.02))) for k in range(60)]
    got = {r["doc_id"]: r for r in N.near_documents(documents(rows)).collect()}
    hashed = {i: word_hashes(t) for i, t in rows}
    ids = sorted(hashed)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if N.edit_similarity(hashed[a], hashed[b]) >= 0.8]
    want = components(pairs, ids)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_near_documents_of_many_edits(documents):
    rng = random.Random(14)
    rows, near = [], 0
    for k in range(300):
        w = words(rng, rng.choice([5, 8, 12, 20, 40, 100, 200]))
        other = list(w)
        for i in rng.sample(range(len(w)), int(len(w) * rng.choice([0.1, 0.15, 0.2]))):
            other[i] = f"e{rng.randrange(99999)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        near += N.edit_similarity(word_hashes(rows[-2][1]), word_hashes(rows[-1][1])) >= 0.8
    got = {r["doc_id"]: r["class_id"] for r in N.near_documents(documents(rows)).collect()}
    assert near == 300 and got == {i: i // 2 * 2 for i in range(600)}


def test_recall_of_near_documents(documents):
    """Pairs of 200 words with 5 to 20 % of the words replaced, and beside each a smaller document that shares 60 % with both."""
    rng = random.Random(15)
    rows, pairs = [], {}
    for share in (0.05, 0.1, 0.15, 0.2):
        for k in range(int(1000 * share), int(1000 * share) + 40):
            w = words(rng, 200)
            other, hub = list(w), list(w)
            for i in rng.sample(range(200), int(200 * share)):
                other[i] = f"e{rng.randrange(99999)}"
            hub[120:] = words(rng, 80)
            rows += [(k, " ".join(hub)), (1000 + 2 * k, " ".join(w)), (1001 + 2 * k, " ".join(other))]
            assert N.edit_similarity(word_hashes(rows[-2][1]), word_hashes(rows[-1][1])) >= 0.8 > N.edit_similarity(word_hashes(rows[-3][1]), word_hashes(rows[-2][1]))
            pairs.setdefault(share, []).append((1000 + 2 * k, 1001 + 2 * k))
    got = {r["doc_id"]: r["class_id"] for r in N.near_documents(documents(rows)).collect()}
    for share, own in pairs.items():
        assert sum(got[a] == got[b] == a for a, b in own) >= 0.95 * len(own), share
    assert all(got[k] == k for k, _ in rows if k < 1000)


def test_near_documents_in_large_buckets(documents, monkeypatch):
    """Many documents that share most of their text with all others, and near copies of some of these."""
    monkeypatch.setattr(N, "FEW", 4)
    rng = random.Random(17)
    common, rows, want = words(rng, 120), [], {}
    for k in range(60):
        own = [*common, *words(rng, 80)]
        for c in range(1 + (k % 3 == 0) * 2):
            other = edited(rng, own, 0.03) if c else own
            rows.append((10 * k + c, " ".join(other)))
            want[10 * k + c] = 10 * k
    got = {r["doc_id"]: r["class_id"] for r in N.near_documents(documents(rows)).collect()}
    assert got == want


@pytest.mark.parametrize("members, edits", [(160, 23), (300, 24), (100, 22)])
def test_near_documents_of_a_family_without_its_original(documents, members, edits):
    """Texts with other edits of one text that isn't there: many share entries, few are similar."""
    rng = random.Random(members)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(members):
        words = list(base)
        for k in rng.sample(range(200), edits):
            words[k] = f"e{i}x{k}"
        texts.append(words)
    hashed = [word_hashes(" ".join(t)) for t in texts]
    pairs = [(i, j) for j in range(members) for i in range(j) if N.edit_similarity(hashed[i], hashed[j]) >= N.SIMILAR]
    got = {r["doc_id"]: r["class_id"] for r in N.near_documents(documents([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    want = components(pairs, range(members))
    wrong = [i for i in range(members) if got[i] != want[i]]
    assert pairs and len(wrong) <= 0.01 * members, (len(pairs), len(set(want.values())), wrong)


def test_near_documents_edges(documents):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  two"), (None, "one two"), (6, "x " * 30000), (7, "x " * 30000), (4, "one two"), (8, "a b c d e f g")]
    out = N.near_documents(documents(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_copies"], r["kept"]))
    assert len(out) == len(rows) and by[5] == [(4, 3, False)] and by[4] == [(4, 3, True)] * 2 and by[7] == [(6, 2, False)]
    assert all(by[i] == [(i, 1, True)] for i in (1, 2, 3, 8)) and by[None] == [(None, 1, True)]
    assert N.near_documents(documents(rows).limit(0)).count() == 0


# Passages --------------------------------------------------------------------------------------------------------------
def test_compact_windows_against_brute_force():
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(40)}" for _ in range(160))
    batch = Batch([text, "short", None, text])
    from tidemark.llm.shingles import mixed

    h = mixed(batch.shingles, 1)[: int(batch.counts[0])]
    t, l, c, r = S.compact_windows(batch, 1)
    own = [(int(a), int(b), int(d)) for k, a, b, d in zip(t, l, c, r) if k == 0]
    for a, b, d in own:
        assert a <= b <= d and d - a + 1 >= S.RUN and h[a : d + 1].min() == h[b]
    for i in range(len(h)):
        for j in range(i + S.RUN - 1, len(h)):
            assert any(a <= i and j <= d and h[b] == h[i : j + 1].min() for a, b, d in own)
    assert set(t.tolist()) == {0, 3}


def test_passages_against_brute_force(documents):
    rng = random.Random(7)
    rows, shared = [], [words(rng, n) for n in (51, 60, 120, 300, 49, 30)]
    for i in range(60):
        w = words(rng, rng.randrange(20, 200))
        for k, p in enumerate(shared):
            if i % (k + 4) == 0:
                at = rng.randrange(len(w))
                w[at:at] = p
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, None), (102, "one two"), (None, rows[4][1]), (103, " ".join(shared[4]))]
    found = S.repeated_passages(documents(rows)).collect()
    covered = {}
    for r in found:
        assert r["end_word"] - r["start_word"] >= 50 and r["kept"] == (r["first_doc_id"] == r["doc_id"])
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen = {}
    for i, t in rows:
        w = (t or "").split() if i is not None else []
        for a in range(len(w) - 49):
            seen.setdefault(tuple(w[a : a + 50]), set()).add((i, a))
    need = {}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                need.setdefault(i, set()).update(range(a, a + 50))
    assert set(need) == set(covered)
    assert all(need[i] <= covered[i] and len(covered[i] - need[i]) <= 20 for i in need)
    assert S.repeated_passages(documents(rows).limit(0)).count() == 0


def test_passages_with_phrases_that_stand_elsewhere(documents):
    rng = random.Random(11)
    rows, need = [], {}

    def add(doc, *parts):
        at = 0
        for part, wanted in parts:
            if wanted:
                need.setdefault(doc, set()).update(range(at, at + len(part)))
            at += len(part)
        rows.append((doc, " ".join(w for part, _ in parts for w in part)))

    for k in range(4):
        p, phrase = words(rng, 60 + 20 * k), words(rng, 7)
        p[25:32] = phrase
        add(10 * k, (phrase, False), (words(rng, 40), False), (p, True), (words(rng, 9), False))
        add(10 * k + 1, (words(rng, 30), False), (p, True), (words(rng, 5), False), (phrase, False))
        twice = words(rng, 55)
        add(10 * k + 2, (twice, True), (words(rng, 40), False), (twice, True))
        add(10 * k + 3, (words(rng, 8), False), (twice, True))
        close = words(rng, 90)
        close[42:49] = phrase = words(rng, 7)
        other = [*close]
        other[60] = "edited"
        add(10 * k + 4, (phrase, False), (words(rng, 60), False), (close, True))
        add(10 * k + 5, (other, True), (words(rng, 60), False), (phrase, False))
    covered = {}
    for r in S.repeated_passages(documents(rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert set(covered) == set(need)
    assert all(need[i] <= covered[i] and len(covered[i] - need[i]) <= 12 for i in need)


@pytest.mark.parametrize("few", [32, 4])
def test_passages_whose_smallest_document_is_a_cut_copy(documents, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(13)
    p = words(rng, 50)
    cut = [(k, " ".join([*words(rng, 30), *p[3 * k : 3 * k + 32], *words(rng, 30)])) for k in range(7)]
    whole = [(100 + k, " ".join([*words(rng, 20), *p, *words(rng, 20)])) for k in range(5)]
    got = {(r["doc_id"], r["first_doc_id"], r["kept"]) for r in S.repeated_passages(documents([*cut, *whole])).collect()}
    assert got == {(d, 100, d == 100) for d, _ in whole}


def test_exact_passages_of_which_the_smallest_document_has_a_part(documents):
    rng = random.Random(19)
    rows = []
    for k in range(100):
        p = words(rng, 52)
        at = rng.randrange(6)
        rows += [(k, " ".join([*words(rng, 40), *p[at : at + 47], *words(rng, 40)])), (1000 + k, " ".join([*words(rng, 30), *p, *words(rng, 30)])), (2000 + k, " ".join([*words(rng, 50), *p, *words(rng, 9)]))]
    got = {(r["doc_id"], r["first_doc_id"], r["kept"]) for r in S.repeated_passages(documents(rows)).collect() if r["doc_id"] >= 1000}
    assert got == {(1000 + k, 1000 + k, True) for k in range(100)} | {(2000 + k, 1000 + k, False) for k in range(100)}


def test_edited_passages_behind_a_head_that_all_documents_share(documents):
    """Each pair goes on with 60 words of its own, one of them replaced: anywhere, the first and the last included."""
    rng = random.Random(37)
    head, rows, replaced = words(rng, 60), [], {}
    for k in range(100):
        tail = words(rng, 60)
        other = list(tail)
        replaced[k] = at = [0, 59, 1, 58][k] if k < 4 else rng.randrange(60)
        other[at] = "edited"
        rows += [(k, " ".join([*words(rng, 20), *head, *tail, *words(rng, 20)])), (1000 + k, " ".join([*words(rng, 25), *head, *other, *words(rng, 25)]))]
    covered = {}
    for r in S.repeated_passages(documents(rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    need = {1000 + k: set(range(25, 145)) - {85 + at} for k, at in replaced.items()}
    assert [i for i in need if len(need[i] - covered.get(i, set())) > 6] == []


@pytest.mark.parametrize("edits, least", [(1, 0.95), (2, 0.9)])
def test_recall_of_edited_passages(documents, edits, least):
    """Passages of 100 words with so many words replaced, evenly spread, in documents that share nothing else."""
    rng = random.Random(23)
    rows = []
    for k in range(100):
        p = words(rng, 100)
        q = list(p)
        for e in range(edits):
            q[100 * (2 * e + 1) // (2 * edits)] = "edited"
        rows += [(k, " ".join([*words(rng, 40), *p, *words(rng, 40)])), (1000 + k, " ".join([*words(rng, 30), *q, *words(rng, 30)]))]
    found = {r["doc_id"]: r["end_word"] - r["start_word"] for r in S.repeated_passages(documents(rows)).collect() if r["doc_id"] >= 1000}
    assert sum(found.get(1000 + k, 0) >= 90 for k in range(100)) >= least * 100


def test_windows_of_every_hash_function_have_keys(documents):
    """Pairs of passages of 60 words with one word replaced, none of whose windows by the first hash function is in both."""
    rng = random.Random(47)
    rows = []
    while len(rows) < 40:
        p = words(rng, 60)
        q = [*p[:30], "edited", *p[31:]]
        x, y = [*words(rng, 40), *p, *words(rng, 40)], [*words(rng, 30), *q, *words(rng, 30)]
        batch = S.Batch([" ".join(x), " ".join(y)])
        keys = lambda n: [{k for t, k in zip(*(a.tolist() for a in S.window_keys(batch, n))) if t == side} for side in (0, 1)]
        if not set.intersection(*keys(1)) and set.intersection(*keys(3)):
            rows += [(len(rows) // 2, " ".join(x)), (1000 + len(rows) // 2, " ".join(y))]
    text, key = S.window_keys(batch)
    assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())
    found = {r["doc_id"] for r in S.repeated_passages(documents(rows)).collect() if not r["kept"]}
    assert len(found) >= 15  # none with keys of the first alone


def test_edited_passages_around_a_line_of_a_large_bucket(documents, monkeypatch):
    """120 documents share a line of 36 words, and each two of them 12 words before and after it as well, with a word
    replaced beside the line. What is found is what is found if every bucket is expanded to all its pairs."""
    rng = random.Random(41)
    line, rows = words(rng, 36), []
    for k in range(60):
        before, after = words(rng, 12), words(rng, 12)
        rows += [(k, " ".join([*words(rng, 20), *before, *line, *after, *words(rng, 20)])), (1000 + k, " ".join([*words(rng, 25), *before[:-1], "edited", *line, *after, *words(rng, 25)]))]

    def found():
        return {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in S.repeated_passages(documents(rows)).collect()}

    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "HUBS", 4)
    got = found()
    monkeypatch.setattr(S, "FEW", 1000)
    want = found()
    assert len({d for d, *_ in want if d >= 1000}) >= 50 and got == want


def test_edited_passages_of_a_large_bucket_meet_all_others(documents, monkeypatch):
    """60 documents share a passage of 60 words, each with a word of its own replaced; those of smallest id have 40 words of
    it. Being covered with one document doesn't keep a window from the others: the rows are those of all pairs."""
    rng = random.Random(53)
    p, rows = words(rng, 60), []
    for k in range(12):
        rows.append((k, " ".join([*words(rng, 20), *p[2 * k % 20 : 2 * k % 20 + 40], *words(rng, 20)])))
    for k in range(60):
        q = list(p)
        q[10 + (7 * k) % 40] = f"edit{k}"
        rows.append((100 + k, " ".join([*words(rng, 20), *q, *words(rng, 20)])))

    def found():
        return {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"], r["kept"]) for r in S.repeated_passages(documents(rows)).collect()}

    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "HUBS", 4)
    monkeypatch.setattr(S, "FEW", 4)
    got = found()
    monkeypatch.setattr(S, "FEW", 1000)
    want = found()
    assert len({d for d, *_, kept in want if not kept}) >= 40 and got == want


def test_agreeing_places_against_sets(monkeypatch):
    rng = np.random.default_rng(43)
    x, y = (rng.integers(1, 60, (40, 2 * S.RUN - 1)).astype(np.uint32) for _ in range(2))
    x[:, :10], y[:5, 40:] = 0, 0
    most = lambda a, b: max(sum(v > 0 and v in b for v in a[s : s + S.RUN].tolist()) for s in range(S.RUN))
    near = [(i, j) for i in range(40) for j in range(40) if most(x[i], set(y[j].tolist())) >= S.NEAR]
    assert 0 < len(near) < 1600
    assert list(zip(*(a.tolist() for a in S.agreeing_places(x, y)))) == near
    monkeypatch.setattr(S, "COLUMNS", 16)  # several shingles a column let more pairs through, none less
    assert set(zip(*(a.tolist() for a in S.agreeing_places(x, y)))) >= set(near)


def test_tiles_of_a_large_bucket_are_dealt_one_by_one(spark):
    """A bucket's tiles are no single task's: Spark would take the joins' partitions by key if they were grouped by it."""
    around = spark.createDataFrame([(1, k, 0, bytes(4 * (2 * S.RUN - 1))) for k in range(100)], "key long, node long, at long, near binary").hint("merge")
    met = S._met(around.select("key", "node", "at"), around, 16)
    assert "hashpartitioning(tile#" in met._jdf.queryExecution().executedPlan().toString()


def test_phrases_shorter_than_a_passage_stay_in_their_tiles(spark):
    """Of two texts with one word 44 times in a row, hundreds of windows share their key and no passage; a third and a
    fourth share a passage with an edit. Windows with the same surroundings of one text are one hub."""
    rng = np.random.default_rng(5)
    own = lambda n: rng.integers(10, 1 << 31, n, dtype=np.uint32)
    long_ = own(2 * S.RUN - 1)
    edit = long_.copy()
    edit[20:25] = own(5)
    phrase = lambda before: np.concatenate([own(before), np.full(40, 5, np.uint32), own(2 * S.RUN - 41 - before)])
    x, y = np.stack([phrase(26), long_]), np.stack([phrase(24), phrase(30), edit, edit])
    assert list(zip(*(a.tolist() for a in S.agreeing_places(x, y)))) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert list(zip(*(a.tolist() for a in S.agreeing_places(x, y, np.array([1, 3]), np.array([2, 2, 4, 4]))))) == [(1, 2)]
    assert not len(S.agreeing_places(x, y, np.array([1, 4]), np.array([2, 2, 4, 4]))[0])
    rows = [(7, n, at, v.tobytes()) for n, at, v in [(1, 40, x[0]), (3, 40, x[1]), (2, 9, y[0]), (2, 10, y[1]), *((4, k, edit) for k in range(300))]]
    around = spark.createDataFrame([(k, n, at, bytearray(v)) for k, n, at, v in rows], "key long, node long, at long, near binary")
    met = S._met(around.where("node % 2 = 1").select("key", "node", "at"), around, 1 << 10)
    assert [(r["a"], r["b"]) for r in met.collect()] == [(3, 4)]
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_aligned_in_cells_of_two_blocks(spark, monkeypatch):
    """Each text goes once to each group of pairs, whatever the blocks; an id of several texts has those of all."""
    rng = random.Random(59)
    p = words(rng, 80)
    rows = [(k, " ".join([*words(rng, 10 + k), *p[: 20 + k], "edited", *p[21 + k :], *words(rng, 5)])) for k in range(9)] + [(4, " ".join(words(rng, 70))), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(a + 1, 10)], "a long, b long")
    sides = [(k, S.sides_of(S.Batch([t]))[0]) for k, t in rows if t]
    want = set()
    for a, x in sides:
        for b, y in sides:
            if a < b:
                own, other = S.shared_passages(x, y)
                want |= {(a, s, e, a) for s, e in own} | {(b, s, e, a) for s, e in other}
    for cell in (512, 2):
        monkeypatch.setattr(S, "CELL", cell)
        made = S._aligned(pairs, docs)
        assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in made.collect()} == want and len(want) > 60


def test_passages_of_very_long_texts(documents):
    rng = random.Random(29)
    p = words(rng, 60)
    long_ = words(rng, 60_000)
    long_[30_000:30_060] = p
    rows = [(1, " ".join(long_)), (2, " ".join([*words(rng, 20), *p])), (3, "x " * 50_000), (4, "x " * 40_000), (5, "y " * 30_000)]
    got = {(r["doc_id"], r["kept"]): (r["start_word"], r["end_word"]) for r in S.repeated_passages(documents(rows)).collect()}
    assert got == {(1, True): (30_000, 30_060), (2, False): (20, 80), (3, True): (0, 50_000), (4, False): (0, 40_000)}


def test_cutting(documents, spark):
    assert S.without("a b  c\nd e", [(1, 3)]) == "a d e" and S.without("a b", [(0, 2)]) == "" and S.without("a b", []) == "a b"
    docs = documents([(1, "a b c d"), (2, "x y"), (3, None), (None, "q"), (4, "k l")])
    cut = spark.createDataFrame([(1, 1, 3, 0, False), (2, 0, 2, 0, False), (4, 0, 1, 4, True)], "doc_id long, start_word long, end_word long, first_doc_id long, kept boolean")
    out = S.drop_passages(docs, cut)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("a d", 3), 3: (None, None), None: ("q", 1), 4: ("k l", 3)}


# Pipeline --------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = [before]
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] and counts[2] - counts[3] <= 0.05 * before
    # nothing is left that the stages look for
    assert N.near_documents(docs).where("not kept").count() <= 0.02 * before
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert [n for n, _ in C.STAGES] == ["language id", "minhash near-dedup", "substring dedup", "packing"]
    run = C.run(spark, sf)
    assert run.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_stages_on_odd_rows(spark, documents):
    import corpus_pipeline as C

    rng = random.Random(21)
    text = " ".join(words(rng, 80))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, "en", "s"), (None, text, None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, "12 34", None, "s"), (6, text + " x" * 3000, "en", "s")]
    docs = documents(rows).withColumn("_gone0", F.lit(1)).withColumn("class", F.lit("c"))
    named, deduped, cut = docs, None, None
    for (name, stage), want in zip(C.STAGES[:-1], ([1, 1, 2, None, 6], [1, 1, None, 6], [1, 1, None, 6])):
        named = stage(spark, named, "")
        assert named.columns == docs.columns
        assert sorted((r["doc_id"] for r in named.collect()), key=lambda i: (i is None, i)) == sorted(want, key=lambda i: (i is None, i)), name
    assert {r["doc_id"]: len(r["text"].split()) for r in named.collect()} == {1: 80, None: 80, 6: 3000}
    assert sorted(r["doc_id"] or 0 for r in C.STAGES[-1][1](spark, named, "").where("start = 0").collect()) == [0, 1, 1, 6]
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small table: languages by their words, classes and passages by all pairs, pieces by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    rng = random.Random(31)
    of = {"en": [f"the{i}ing" for i in range(300)], "de": [f"der{i}ung" for i in range(300)]}
    of = {k: ["".join(chr(97 + (ord(c) - 48)) if c.isdigit() else c for c in w) for w in v] for k, v in of.items()}
    pick = lambda lang, n: [rng.choice(of[lang]) for _ in range(n)]
    rows, shared = [], pick("en", 60)
    for i in range(60):
        lang = rng.choice(["en", "de"])
        w = pick(lang, rng.randrange(60, 160))
        if lang == "en" and i % 3 == 0:
            w[20:20] = shared
        rows.append((i, " ".join(w), lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 7)]
    for i in range(0, 60, 11):
        w = rows[i][1].split()
        w[5], w[40] = "edit", "edit"
        rows.append((200 + i, " ".join(w), rows[i][2]))
    rows += [(300, "12 34", None), (301, None, "en"), (302, "", "de")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t.split() for i, t, _ in rows if t and not t[0].isdigit()}
    hashed = {i: word_hashes(" ".join(w)) for i, w in texts.items()}
    ids = sorted(texts)
    roots = components([(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if N.edit_similarity(hashed[a], hashed[b]) >= 0.8], ids)
    texts = {i: w for i, w in texts.items() if roots[i] == i}
    left = {}
    for i in sorted(texts):
        gone, seen = set(), {tuple(w[k : k + 50]) for j, w in texts.items() if j < i for k in range(len(w) - 49)}
        for k in range(len(texts[i]) - 49):
            if tuple(texts[i][k : k + 50]) in seen:
                gone.update(range(k, k + 50))
        left[i] = " ".join(w for k, w in enumerate(texts[i]) if k not in gone)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items() if x}
    assert sum(len(left[i].split()) < len(w) for i, w in texts.items()) > 5
    out = C.run(spark, str(tmp_path)).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert {i: p[0][2] for i, p in got.items()} == want
    assert all(sum(n for _, n, _ in p) == want[i] for i, p in got.items())


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(Q.QUERIES) <= names and "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in Q.QUERIES}
