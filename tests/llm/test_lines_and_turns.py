"""Line dedup, fill-in-middle and the conversation trie against plain Python."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tests.oracle import same
from tidemark.llm.conversation_trie import SlotTable, _nodes, prefix_trie, read_turns, share_openings
from tidemark.llm.fill_in_middle import fill_in_middle, restore
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string, at long, a long, owner long, content string, tokens long, n long"


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_fill_in_middle", "op13_line_dedup"])
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


# lines


def brute_lines(rows, least_chars=10, least_documents=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    having = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least_chars:
                having[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(having[key(x)]) < least_documents or doc == min(having[key(x)])]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


LINES = [
    (3, "A line of text\nown line of three\n\n  a LINE of text\t"), (1, "a line of text\nshort\nshort"), (2, "short\na line of text\r\nÄ line of text"), (4, "ä line of text\nshort"), (5, None), (6, ""), (7, "\n\n"),
    (8, "only here twice\nonly here twice"), (9, "a line of text"), (9, "a line of text"), (9, "another row of nine\nA line of text"), (10, "another row of nine"), (None, "a line of text\nkept"), (None, "a line of text\nkept"),
    (11, "123456789\n1234567890"), (12, "123456789\n1234567890\x0b"), (13, "é23456789\né234567890"), (14, "é23456789\né234567890"), (15, " a line of text"), (16, "a line of text more text here"), (-5, "1234567890"),
]


def test_lines_as_brute_force(documents):
    got = sorted((tuple(r) for r in drop_repeated_lines(documents(LINES)).collect()), key=repr)
    assert got == brute_lines(LINES)
    got = sorted((tuple(r) for r in drop_repeated_lines(documents(LINES), least_chars=5, least_documents=3).collect()), key=repr)
    assert got == brute_lines(LINES, 5, 3)


def test_lines_hot_long_and_empty(documents):
    long = "\n".join(f"line number {i % 7000} of a long text" for i in range(20_000))
    rows = [(i, f"the very common line\nline number {i} of a long text") for i in range(3000)] + [(9000, long), (9001, long), *[(9002, "the very common line")] * 500]
    got = sorted((tuple(r) for r in drop_repeated_lines(documents(rows)).collect()), key=repr)
    assert got == brute_lines(rows)
    assert drop_repeated_lines(documents(rows).limit(0)).collect() == []


# fill-in-middle


def brute_middle(doc, text, percent=100, spm_percent=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    p, s, m = markers
    if not text or any(x in text for x in markers) or h[2] % 100 >= percent:
        return doc, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm_percent:
        return doc, len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle, text
    return doc, len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle, text


ODD = ["a", "\n", "\n\n", "a\n", "a\nb", "\na", "<P", "P>\n<", "S>\n<S\nM>", "x<M>y", "<S>", "é\n日本\n𝄞 x\r\ny z", "a\n" * 5000, "z" * 100_000, "", None, "|\n.*\n\\n"]


def test_middle_as_brute_force(documents):
    rows = [(k * len(ODD) + i, t) for k in range(20) for i, t in enumerate(ODD)] + [(None, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc"), (-3, "a\nb\nc")]
    for options in ({}, {"percent": 60, "spm_percent": 20}, {"markers": ("[(p)]", "|s|", ".m.")}):
        markers = options.get("markers", ("<P>", "<S>", "<M>"))
        made = restore(fill_in_middle(documents(rows), **options), markers)
        assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted((brute_middle(*r, **options) for r in rows), key=repr)
    assert {r[2] for r in made.select("doc_id", "n", "form").distinct().collect()} == {"plain", "psm", "spm"}
    assert restore(fill_in_middle(documents(rows).limit(0))).collect() == []


# the trie


def test_slots_are_one_to_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rng.integers(-(2**62), 2**62, n), rng.integers(0, 3, n)
        a[: n // 2] = np.arange(n // 2)
        a, b = np.unique(np.stack([a, b]), axis=1)
        table = SlotTable(a, b)
        assert sorted(table.slots) == list(range(len(a)))
        assert (table.find(a, b) == table.slots).all()
        assert (table.find(a, b + 3) == -1).all()


def brute_trie(rows):
    key = lambda r, t: f"{len(r.encode())}:{r}{t}".encode()
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, sha256(key(role, text)).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c, x in own.items():
        base, h = c - (abs(c) % 5) * (1 if c > 0 else -1), crc32(str(c).encode()) % 9
        made[c] = own.get(base, [])[:h] + x[h:]
    members, ends, children = defaultdict(list), defaultdict(list), Counter()
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += children[node] == 0
    sha = lambda ids: sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((w[0], len(x), members[x[:-1]][0] if x else None, len(w), children[x], leaves[x], saved[x], sha(ends[x])) for x, w in members.items()),
        key=repr,
    )


def trie(spark, rows, members=2000, shard_runs=20_000):
    turns, ids = share_openings(read_turns(spark.createDataFrame([(*r, 7, 7, 7, "x", 7, 7) for r in rows], TURNS)), 5, 9)
    return sorted((tuple(r) for r in prefix_trie(turns, ids, members, shard_runs).collect()), key=repr)


def conversations(seed, n, texts):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.integers(1, 14)):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"t{rng.integers(0, texts)}é"))
    return rows


@pytest.mark.parametrize("members, shard_runs", [(2000, 20_000), (3, 4), (1, 1), (20, 5)])
def test_trie_as_brute_force(spark, members, shard_runs):
    rows = conversations(2, 60, 2)
    rows += [(100 + c, turn, "user", f"same {turn}") for c in range(30) for turn in range(4)]  # copies
    assert trie(spark, rows, members, shard_runs) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, "a", "first"), (1, None, "a", "first"), (1, 1, None, None), (1, 1, "", ""), (1, 1, "b", "tie"), (1, 1, "c", "tie"), (None, 1, "a", "of nobody"), (-3, 2, "a", "negative"), (-3, 1, "a", "negative"),
        (7, 0, "u", "no base"), (8, 0, "u", "x" * 70_000), (9, 5, "ab", "c"), (9, 6, "a", "bc"), (13, 0, "a", "bc"), (2**40 + 1, 0, "u", "far"), *[(30, t, "u", f"long {t % 7}") for t in range(5000)],
        *[(31, t, "u", f"long {t % 7}") for t in range(5000)],
    ]
    assert trie(spark, [r for r in rows if r[0] not in (30, 31)], 2) == brute_trie([r for r in rows if r[0] not in (30, 31)])
    got = {r[:2]: r for r in trie(spark, rows, 1)}  # a long run of nodes with two members
    assert got[30, 5000][3:6] == (2, 0, 1) and got[30, 1][5] == 1
    assert got[30, 1][6] == sum(len(f"long {t % 7}") for t in range(5000))
    assert trie(spark, [(None, 1, "a", "b")]) == []


def test_equal_digests_of_other_prefixes_are_told(spark):
    rows = [(1, 1, 5, 6, 0, 0, 11, 3, 3), (2, 1, 5, 6, 0, 0, 11, 3, 3), (3, 1, 5, 6, 0, 0, 12, 3, 3)]
    prefixes = spark.createDataFrame(rows, "conv_id long, at long, a long, b long, pa long, pb long, turn long, tokens long, upto long")
    assert _nodes(prefixes.where("conv_id < 3"))[1]
    assert not _nodes(prefixes)[1]
