"""HTML extraction, language ID, token counts, packing, URL rules, byte-level BPE."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tidemark.llm import html_text as H
from tidemark.llm import language as G
from tidemark.llm import packing as P
from tidemark.llm import queries as Q
from tidemark.llm import token_rollup as R
from tidemark.llm import url_rules as U
from tidemark.llm.bpe import BytePairs, PerfectHash, _codec, encode_decode
from tidemark.llm.vocabulary import read_ranks

TEXTS = ["", None, "a", " x", "x ", "aaaa  bb\n c\t d", "'s don't  \n\n x y", "é" * 3000, "a" * 20000, "　 z", "日本 語 ١٢ ²³ ́x", "Hello world, hello.\nWorld", "Hello world, hello.\nWorld", "<|endoftext|> y"]


# HTML ------------------------------------------------------------------------------------------------------------------
def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def main(own, other=None):
    lines, near = H.blocks_of(own), H.blocks_of(other or "")
    shared = set(H.shared_lines([x.text for x in lines], [x.text for x in near]))
    return "\n".join(lines[i].text for i in H.main_lines(lines, shared))


def test_blocks_and_parts():
    body = "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='ad'>Buy</div><div id=\"cookie-notice\"><p>We use cookies</p></div><header><h2>Site</h2></header>"
    body += "<article><div class='post-header'><h1>T &amp; U</h1></div><p>One\n  two&nbsp;three<br>four<p>Five <b>six</b></p><ul><li>seven<li>eight</ul><form>f<input></form>"
    body += "<aside>side</aside><section class='comments'><p>first!</p></section></article><footer>f</footer>"
    assert main(page(body)) == main(page(body), page(body)) == "T & U\nOne two three four\nFive six\nseven\neight"


def test_broken_markup():
    assert main("<body><nav><ul><li>m<article><p>kept<p>also") == "kept\nalso"
    assert H.blocks_of("") == [] and main("plain text") == "plain text"
    assert main("<p>a <!-- open") == "a"
    assert main("<p>x</p><script>var a = '<p>no</p>'") == "x"


def test_shared_lines_go_where_no_article_is_marked():
    one, two = "<p>Top stories today</p><p>Alpha text</p><p>Legal text below</p>", "<p>Top stories today</p><p>Beta text</p><p>Legal text below</p>"
    assert main(one, two) == "Alpha text" and main(one) == "Top stories today\nAlpha text\nLegal text below"
    assert main(f"<p>Menu</p><article>{one}</article>", f"<p>Menu</p><article>{two}</article>") == "Top stories today\nAlpha text\nLegal text below"


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(row[j], rows[-1][j + 1]))
        rows.append(row)
    return rows[-1][-1]


def test_shared_lines_against_brute_force():
    import random

    rng = random.Random(9)
    assert H.shared_lines(list("xaybzc"), list("paqbrcs")) == [1, 3, 5] and H.shared_lines([], list("a")) == []
    for k in range(300):
        a, b = ([rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randrange(40))] for _ in range(2))
        found = H.shared_lines(a, b)
        assert found == sorted(set(found)) and len(found) == longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)  # they stand in b in that order


def test_pages_of_many_lines_need_little_memory():
    import random
    import tracemalloc

    rng = random.Random(3)
    a = list(range(100_000))
    b = [x if rng.random() < 0.5 else -x for x in a]
    tracemalloc.start()
    found = H.shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(found) == sum(x == y for x, y in zip(a, b))
    many = "".join(f"<p>line {i}</p>" for i in range(100_000))
    assert main(many, "".join(f"<p>line {i}</p>" for i in range(0, 100_000, 2))).count("\n") == 49_999


def test_extraction_of_tables(spark):
    rows = [
        (1, "http://a.com/x/1", "<p>Head</p><p>one</p>"), (2, "http://a.com/x/2", "<p>Head</p><p>two</p>"), (2, "http://a.com/x/2", "<p>Head</p><p>two</p>"), (3, None, None), (None, "nourl", ""),
        (4, "http://b.com/", page("<article>only</article>")), (5, "nourl", "<p>Head</p>"),
    ]
    df = spark.createDataFrame([(*r, 1, "h", "c") for r in rows], "page_id long, url string, html string, h int, p string, common string")
    out = H.extract_text(df, U.host_of(F.col("url")), U.path_of(F.col("url"))).collect()
    assert len(out) == len(rows)
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_shared"]) for r in out)
    assert got == [(0, "", 0, 0), (1, "one", 3, 1), (2, "two", 3, 1), (2, "two", 3, 1), (3, "", 0, 0), (4, "only", 4, 0), (5, "Head", 4, 0)]
    assert H.extract_text(df.limit(0), U.host_of(F.col("url")), U.path_of(F.col("url"))).count() == 0


def nearest_by_brute_force(pages):
    """page_id -> text. Each page against the distinct pages of its host, in order of path."""
    lines = {i: H.blocks_of(h) for i, _, _, h in pages}
    told, out = {i: tuple(x.text for x in lines[i]) for i in lines}, {}
    for i, host, path, _ in pages:
        least = {}
        for j, other, p, _ in pages:
            if other == host and told[j]:
                least[told[j]] = min(least.get(told[j], p), p)
        order = sorted((p, t) for t, p in least.items())
        shared = set()
        if told[i]:
            at = next(k for k, x in enumerate(order) if x[1] == told[i])
            near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
            if near:
                own = order[at][0]
                alike = [next((k for k, (x, y) in enumerate(zip(n[0], own)) if x != y), min(len(n[0]), len(own))) for n in near]
                shared = set(H.shared_lines(list(told[i]), list(near[alike.index(max(alike))][1])))
        out[i] = "\n".join(lines[i][k].text for k in H.main_lines(lines[i], shared))
    return out


def test_extraction_is_the_same_for_all_partitions(spark):
    import random

    rng = random.Random(12)
    pages = []
    for i in range(400):
        host, path = f"h{rng.choice([0, 0, 0, 1, 2])}.com", f"/{rng.choice('ab')}/{i:04}"
        text = rng.randrange(250)
        body = f"<p>Menu</p><p>Terms {text % 3}</p><p>text {text}</p><p>more {text}</p><p>Contact</p>"
        pages.append((i, host, path, f"<article>{body}</article><p>Foot</p>" if text % 5 == 0 else body))
    want = nearest_by_brute_force(pages)
    assert sum("Menu" in t for t in want.values()) == sum("<article>" in h for *_, h in pages)
    df = spark.createDataFrame([(i, f"http://{h}{p}", t) for i, h, p, t in pages], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["page_id"]: r["text"] for r in H.extract_text(df.repartition(3), U.host_of(F.col("url")), U.path_of(F.col("url"))).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pages_give_their_articles(spark, sf):
    docs = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    out = Q.op1_html_extraction(spark, sf).collect()
    whole = [" ".join(r["text"].split("\n", 1)[-1].split()) in docs for r in out]
    assert sum(whole) >= 0.95 * len(whole)


# Languages -------------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark, sf):
    named = Q.op2_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    n, right = named.count(), named.where("lang = lang_pred").count()
    assert n > 20 and right / n >= 0.95


def test_spans_of_mixed_text(documents):
    train = documents([(i, t, lang) for i in range(30) for t, lang in (("the cat and the dog with this house", "en"), ("der hund und die katze mit dem haus", "de"), ("кот и собака в доме", "ru"))])
    model = G.learn_languages(train)
    docs = documents([(1, "the dog and the cat with the house der hund und die katze mit dem haus der katze"), (2, "кот и дом"), (3, None), (4, "123 !? ..."), (5, "日本語"), (6, ""), (None, "the cat"), (1, "the cat")])
    out = [(r["doc_id"], r["lang_pred"], round(r["score"], 2), [(s["lang"]) for s in r["spans"]]) for r in G.identify_language(docs, model).collect()]
    assert out[0][3] == ["en", "de"] and out[1][1:3] == ("ru", 1.0)
    assert [o[1] for o in out[2:6]] == ["und", "und", model.languages[0], "und"] and all(o[2] == 0 for o in out[2:6])
    assert out[6][:2] == (None, "en") and len(out) == 8
    assert G.identify_language(docs.limit(0), model).count() == 0
    none = G.learn_languages(documents([(1, None, "en"), (2, "x", None)]))
    assert [r["lang_pred"] for r in G.identify_language(documents([(1, "a")]), none).collect()] == ["und"]


def test_viterbi_against_all_labellings():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(20):
        scores = [tuple(-rng.random() * 9 for _ in range(3)) for _ in range(6)]
        best = max(sum(s[k] for s, k in zip(scores, ks)) - 4.0 * sum(a != b for a, b in zip(ks, ks[1:])) for ks in itertools.product(range(3), repeat=6))
        spans = G.label_spans(scores, 4.0)
        ks = [k for (a, k), (b, _) in zip(spans, [*spans[1:], (6, None)]) for _ in range(b - a)]
        assert sum(s[k] for s, k in zip(scores, ks)) - 4.0 * (len(spans) - 1) == pytest.approx(best)


def test_leaving_out_the_pass_changes_nothing():
    import numpy as np

    rng = np.random.default_rng(7)
    left_out = 0
    for k in range(2000):
        n, langs = rng.integers(1, 40), rng.integers(2, 5)
        scores = (-rng.random((n, langs)) * rng.choice([0.5, 2, 9])).astype(np.float32)
        scores[:, 0] *= rng.choice([0.1, 0.6, 1])
        whole = G.label_spans(scores.tolist(), 4.0)
        short = G.spans_of(scores, 4.0)

        def worth(spans):
            ends = [a for a, _ in spans[1:]] + [n]
            return sum(float(scores[a:b, k].sum()) for (a, k), b in zip(spans, ends)) - 4.0 * (len(spans) - 1)

        assert worth(short) == pytest.approx(worth(whole), abs=1e-4)
        left_out += len(short) == 1
    assert 200 < left_out < 2000


def test_query_against_a_plain_count(spark, sf):
    """The whole query's held-out rows against a Python model over the same sample: every label and score."""
    import zlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    counts = {}
    for r in train:
        for w in G.words_of(r["text"]):
            own = counts.setdefault(r["lang"], {})
            for f in G.features_of(w):
                own[f] = own.get(f, 0) + 1
    counts = {k: {f: n for f, n in own.items() if f[0] != "=" or n > 1} for k, own in counts.items()}
    model = G.Model(counts)
    got = {r["doc_id"]: r for r in Q.op2_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = G.words_of(r["text"] or "")
        table = model.words(words) if words else []
        scores = []
        for w, s in zip(words, table):
            uses = model.candidates(w)
            if uses:
                top = max(x for x, u in zip(s, uses) if u)
                scores.append([float(x - top) if u else -2 * G.SWITCH for x, u in zip(s, uses)])
        held = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert got[r["doc_id"]]["held_out"] == held
        if not scores:
            assert got[r["doc_id"]]["lang_pred"] == "und" or words
            continue
        spans = G.label_spans(scores)
        share = [0] * len(model.languages)
        for (a, k), b in zip(spans, [a for a, _ in spans[1:]] + [len(scores)]):
            share[k] += b - a
        assert got[r["doc_id"]]["score"] == pytest.approx(max(share) / len(scores), abs=0.02)
        assert share[model.languages.index(got[r["doc_id"]]["lang_pred"])] >= max(share) - 1


def test_words_with_combining_marks(documents):
    hindi = "हिन्दी भाषा में लिखा हुआ पाठ"
    assert G.words_of(hindi) == hindi.split()
    model = G.learn_languages(documents([(i, hindi, "hi") for i in range(5)] + [(9, "the text in english", "en")]))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in G.identify_language(documents([(1, hindi), (2, "the text " * 200_000)]), model).collect()}
    assert out == {1: ("hi", 1.0), 2: ("en", 1.0)}


# Token counts ----------------------------------------------------------------------------------------------------------
def test_rollup_against_recount(spark, sf, vocab):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=read_ranks(vocab.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first, want = {}, {}
    for r in docs:
        if r["text"] is not None:
            first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    for r in docs:
        if r["text"] is not None and first[r["text"]] != r["doc_id"]:
            continue
        t = r["text"] or ""
        for v, n in (("byte_bpe_50k", len(enc.encode_ordinary(t)) + 1), ("words", len(t.split()))):
            d, k, c = want.get((r["source"], r["lang"], v), (0, 0, 0))
            want[r["source"], r["lang"], v] = d + 1, k + n, c + len(t)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"], r["chars"]) for r in Q.op3_token_rollup(spark, sf).collect()}
    assert got == want


def of_ledger(ledger):
    return {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}


def test_ledger_counts_each_batch_once(spark, documents, vocab, tmp_path, monkeypatch):
    docs = documents([(1, "a b c", "en", "s"), (2, None, None, None), (2, "d", "en", "s"), (3, "e f", "de", "s")])
    counts = R.count_tokens(docs, {}, vocab.PATTERN)
    ledger = R.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert [ledger.commit("b1", R.inserts(counts)) for _ in range(2)] == [True, False]
    revised = R.revisions(counts.where("doc_id = 1"), counts.where("doc_id = 1").withColumn("tokens", F.lit(10).cast("long")))
    ledger.commit("b2", R.deletes(counts.where("lang = 'de'")), revised)
    want = {("s", "en"): (2, 11), (None, None): (1, 0)}
    assert of_ledger(ledger) == want
    again = R.Ledger(spark, str(tmp_path / "ledger"))  # as after a restart
    assert of_ledger(again) == want and not again.commit("b1", R.inserts(counts)) and [c["batch"] for c in again.commits()] == ["b1", "b2"]
    with pytest.raises(ValueError):
        again.commit("b1", R.inserts(counts.where("doc_id = 1")))
    with pytest.raises(ValueError):
        ledger.commit("../x", R.inserts(counts))
    with monkeypatch.context() as m:  # lost between the totals and the marker
        m.setattr(R.Ledger, "_mark", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            again.commit("b3", R.inserts(counts))
    assert of_ledger(R.Ledger(spark, str(tmp_path / "ledger"))) == want
    assert again.commit("b3", R.deletes(counts.where("doc_id = 2"))) and of_ledger(ledger) == {("s", "en"): (1, 10)}
    assert again.commit("empty", R.inserts(counts.limit(0))) and of_ledger(ledger) == {("s", "en"): (1, 10)}


def test_counts_of_odd_texts(documents, vocab):
    counts = R.count_tokens(documents([(1, "w " * 300_000, "en", "s"), (None, "", None, None)]), {}, vocab.PATTERN)
    assert sorted((r["doc_id"] or 0, r["tokens"], r["chars"]) for r in counts.collect()) == [(0, 0, 0), (1, 300_000, 600_000)]
    assert R.count_tokens(documents([(1, "x")]).limit(0), {}, vocab.PATTERN).count() == 0


# Packing ---------------------------------------------------------------------------------------------------------------
def test_cuts_and_classes():
    for n in range(1, 9000, 7):
        pieces = P.cut_points(n, 2048)
        assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces) and len(pieces) <= n // 2048 + 6
        assert all(P.harmonic_class(p, 2048) * p <= 2048 for p in pieces)


def checked_packing(df, ids, capacity=2048):
    rows = df.collect()
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == struct.pack(f"<{len(part)}I", *part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[d])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return pieces, sequences


def test_packing_is_whole(spark, sf, vocab):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    packed = P.pack_documents(docs.repartition(7), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, 1)
    pieces, sequences = checked_packing(packed, ids)
    assert set(pieces) == set(ids)
    tokens = sum(map(len, ids.values()))
    assert sum(2048 - sum(n for _, n in s) for s in sequences.values()) <= 0.05 * tokens + 2048


def test_packing_ids_are_the_library_s(documents, vocab):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    texts = [x or "" for x in TEXTS] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n y", "<|endoftext|", "<|ENDOFTEXT|>", "a  <|endoftext|>  b"]
    out = Q.packed(documents(list(enumerate(texts)))).where("start = 0").collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
    for r in out:
        ids = (t.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1])[: r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing_edges(documents, vocab):
    docs = documents([(1, None), (2, ""), (3, "a " * 5000), (3, "a " * 5000), (None, "x")])
    out = P.pack_documents(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, 1).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 3) == 2 * max(r["doc_tokens"] for r in out)
    assert [r["length"] for r in out if r["doc_id"] in (1, 2)] == [1, 1] and sum(r["doc_id"] is None for r in out) == 1
    assert P.pack_documents(docs.where("doc_id = 1"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, None).count() == 0
    assert P.pack_documents(docs.limit(0), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, 1).count() == 0
    crc = Q.packed(docs.where("doc_id = 2")).first()
    assert crc["ids_crc32"] == zlib.crc32(struct.pack("<I", 1))


# URLs ------------------------------------------------------------------------------------------------------------------
def test_url_query_against_sql(spark, sf):
    same(Q.op5_url_rules(spark, sf), Q.ORACLES["op5_url_rules"], sf)


def test_url_query_blocks_hosts_that_end_in_a_token(spark, tmp_path):
    urls = ["http://best.casino/x", "http://best.casino", "http://casino.com/x", "http://a.org/casino/x", "http://bestcasino/x", "http://casino/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in Q.op5_url_rules(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]


def test_url_rules_by_hand(spark, monkeypatch):
    urls = ["http://www.Example.com/en/1?x#y", "http://example.com/en/1", "https://a.example.com/de/", "http://x.net/es/a", "http://x.net/es", "http://net/fr/", "ftp://spam.org/", "mailto:x", None, "", "http://example.com", "http://badexample.com/en/", "http://example.com/en/1"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, judged string")
    rules = [U.site_rule(*r) for r in Q.SITE_RULES] + [U.Rule("~spam", r"^spam\.", "block", 0, ["spam"]), U.Rule("~any", r"/zzz$", "block", 0, [])]
    want = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), ("net/fr/", "block"), ("~spam", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("example.com/en/", "block")]
    for few in (10_000, 0):  # sent to all tasks, and joined by token
        monkeypatch.setattr(U, "BROADCAST_RULES", few)
        got = {r["page_id"]: (r["judged"]["rule"], r["judged"]["verdict"]) for r in U.judge_urls(df, rules).collect()}
        assert [got[i] for i in range(len(urls))] == want
    assert {r["judged"]["verdict"] for r in U.judge_urls(df, [], "block").collect()} == {"block"}
    assert U.judge_urls(df.limit(0), rules).count() == 0


def test_many_url_rules_and_long_urls(spark):
    import random
    import re

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rules = []
    for i in range(3000):
        host, path = f"{rng.choice(words)}.{rng.choice(words)}.com", "/" + rng.choice(["", f"{rng.choice(words)}/", f"{rng.choice(words)}"])
        rules.append(U.site_rule(host + path, rng.choice(["allow", "block"])))
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{rng.choice(words)}.{rng.choice(words)}.com/{rng.choice(words)}/{rng.choice(words)}" for _ in range(400)] + [f"http://{r.name}x" for r in rules[:300]]
    urls += ["http://w1.w2.com/" + "w3/" * 100_000, "http://" + "a" * 200_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, best string").withColumn("url", F.col("best")).withColumn("_best0", F.lit(1)).withColumn("_url_key0", F.lit(2))
    out = U.judge_urls(df, rules)
    assert out.columns == [*df.columns, "judged"]
    got = {r["page_id"]: (r["judged"]["rule"], r["judged"]["verdict"]) for r in out.collect()}
    compiled = [(re.compile(r.regex), r) for r in rules]
    for i, u in enumerate(urls):
        site = u.split("://", 1)[1]
        hits = [r for pattern, r in compiled if pattern.search(site)]
        best = min(hits, key=lambda r: (-r.rank, r.name), default=None)
        assert got[i] == ((best.name, best.verdict) if best else (None, "allow"))
    assert sum(rule is not None for rule, _ in got.values()) > 300


# Byte-level BPE --------------------------------------------------------------------------------------------------------
def test_perfect_hash_is_one_to_one():
    import numpy as np
    from xxhash import xxh3_64_intdigest as h

    for n in (1, 2, 3, 10, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        ph = PerfectHash(keys)
        slots = ph.slots(np.array([h(k) for k in keys], np.uint64)).tolist()
        assert sorted(slots) == list(range(n)) and slots == ph.slot_of


def test_bpe_as_the_library(documents, vocab):
    import tiktoken

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    out = {r["doc_id"]: r for r in encode_decode(documents(list(enumerate(TEXTS))), path, vocab.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert out[i]["ids"] == struct.pack(f"<{len(ids)}I", *ids) and out[i]["n_tokens"] == len(ids) and bytes(out[i]["decoded"]) == (t or "").encode()
    assert encode_decode(documents([(1, "x")]).limit(0), path, vocab.PATTERN).count() == 0


def test_merges_against_brute_force(vocab):
    import random

    ranks = read_ranks(vocab.path("byte_bpe_multi_50k.tiktoken"))
    pairs, rng = BytePairs(ranks), random.Random(1)
    for _ in range(100):
        raw = bytes(rng.choice(b"aeinorst \xc3\xa9") for _ in range(rng.randrange(1, 30)))
        parts = [bytes([b]) for b in raw]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert pairs.merged(raw) == [ranks[p] for p in parts]
    assert _codec(ranks, vocab.PATTERN)[0] is _codec(ranks, vocab.PATTERN)[0]
