"""Shared lines, conversation prefixes and phrases against brute force, and the cases each of them must stand."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packstat.llm import langid, lines, mixing, neardup, phrases, prefixes, spans, topk

DOCS = "doc_id long, text string, lang string, rest string, marks string, n_lines string"
SPACE = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """Rows (doc_id, text, lang), with extra columns named like those the operators make."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shared_lines(rows, least_docs, least_chars=1, keep_first=False):
    """(doc_id, n_lines, n_dropped, text) of each row; rows come in the order of ids, null ids last."""
    split = [(t or "").split("\n") for _, t, _ in rows]
    keys = [[ascii_lower(x.strip(SPACE)) for x in ls] for ls in split]
    found = collections.Counter(k for ks in keys for k in set(ks) if len(k) >= least_chars)
    out, seen = [], set()
    for (i, _, _), ls, ks in zip(rows, split, keys, strict=True):
        kept = []
        for line, key in zip(ls, ks, strict=True):
            if found[key] < least_docs or (keep_first and key not in seen):
                kept.append(line)
            seen.add(key)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def some_lines(rng, n):
    pool = ["", " ", "Menu", " menu\t", "MENU", "é", "É", "a b", "long line of many words " * 200, "\x85", "x\ry"]
    pool += [f"line {k}" for k in range(30)]
    return ["\n".join(rng.choice(pool, rng.integers(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"least_chars": 5}, {"keep_first": True}, {"bits": 64}, {"least_docs": 2}])
def test_shared_lines(spark, options):
    rng = np.random.default_rng(11)
    rows = [(i, t, "en") for i, t in enumerate([None, "", "\n", "only here", "only here twice\nonly here twice", *some_lines(rng, 60)])]
    rows += [(200, rows[8][1], "fr"), (200, "menu\nother", None), (None, "menu\nline 3\nof no id", "en")]
    got = lines.drop_shared_lines(documents(spark, rows).repartition(5), **{"least_docs": 10, "keep_text": True} | options)
    assert got.columns == ["doc_id", "lang", "rest", "marks", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    want = shared_lines(rows, options.get("least_docs", 10), options.get("least_chars", 1), options.get("keep_first", False))
    key = lambda r: (r[0] is None, r[0], r[3])
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    if options.get("keep_first"):  # which of the rows of one id comes first is not said
        want, found = ([r for r in x if r[0] != 200] for x in (want, found))
    assert sorted(found, key=key) == sorted(want, key=key)
    assert all(r.kept_sha256 == sha(r.kept_text) for r in got.collect())


def test_filters_merge_in_any_order():
    """A key that any two of three tasks have is in the merged filter of keys seen twice; most others are not."""
    bits = 1 << 16
    keys = [f"key {k}".encode() for k in range(900)]
    has = [keys[:400], keys[300:700], keys[600:] + keys[:50]]
    pairs = []
    for mine in has:
        once = lines.Filter(bits)
        once.add(lines._places(mine, bits), np.arange(len(mine)))
        pairs.append((once.data, np.zeros(bits // 8, np.uint8)))
    for order in ([0, 1, 2], [2, 0, 1]):
        once, twice = pairs[order[0]]
        for k in order[1:]:
            once, twice = once | pairs[k][0], twice | pairs[k][1] | (once & pairs[k][0])
        seen = lines.Filter(8)
        seen.data = twice
        said = dict(zip(keys, seen.has(lines._places(keys, bits)).tolist(), strict=True))
        times = collections.Counter(k for mine in has for k in mine)
        assert all(said[k] for k in keys if times[k] > 1) and sum(said[k] for k in keys if times[k] == 1) < 20


def test_shared_lines_of_an_empty_table(spark):
    none = documents(spark, [(1, "x", "en")]).filter("false")
    assert lines.drop_shared_lines(none).collect() == []


def rebuilt(rows):
    """conv_id to its rebuilt turns; ties of a turn by the hash of role and text."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: head[c]] + ts[head[c]:] for c, ts in own.items()}


def trie(paths):
    """Rows of the trie of paths, node by node."""
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    saved, leaves = collections.Counter(), collections.Counter()
    for node, cs in members.items():
        worth = (len(cs) - 1) * len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += not kids[node]
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], leaves[n], saved[n], sha(",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(n))))
                  for n, cs in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, path string"


@pytest.mark.parametrize("fan_in", [32, 2, 3])
def test_prefix_trie(spark, monkeypatch, fan_in):
    monkeypatch.setattr(prefixes, "FAN_IN", fan_in)
    rng = np.random.default_rng(12)
    rows = []
    for c in range(200):  # a third are copies of each other, most share their first turns
        said = [("user", "hi there"), ("assistant", "a b c")] if c % 3 == 0 else [(("user", "assistant")[k % 2], " ".join("xyz"[i] for i in rng.integers(0, 3, rng.integers(0, 3)))) for k in range(rng.integers(1, 6))]
        rows += [(c, k, *t) for k, t in enumerate(said)]
    rows += [(1000, k, "user", f"deep {k % 2}") for k in range(70)] + [(1001, k, "user", f"deep {k % 2}") for k in range(66)]  # long, of one family
    rows += [(2007, 0, "user", "no first conversation"), (2008, None, None, None), (2008, 1, "user", "x\u00a0y  z\t"), (2008, 1, "user", "x"), (2008, 1, "user", "x"), (-15, 3, "user", "minus"), (None, 0, "user", "nobody")]
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], CONVERSATIONS).repartition(7)
    got = prefixes.prefix_nodes(table, least_shards=11)
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
    key = lambda r: tuple((x is None, x) for x in r)
    paths = rebuilt(rows)
    assert any(not p for p in paths.values()) and max(map(len, paths.values())) > 60
    assert sorted(map(tuple, got.collect()), key=key) == sorted(trie(paths), key=key)


@pytest.mark.parametrize("columns", [1, 2, 16])
def test_order_of_paths_and_what_they_share(monkeypatch, columns):
    monkeypatch.setattr(prefixes, "COLUMNS", columns)
    rng = np.random.default_rng(15)
    paths = [tuple(int(x) for x in rng.integers(0, 2, rng.integers(0, 9))) for _ in range(120)] + [(0,) * k for k in (0, 40, 40, 50)]
    length, conv = np.array([len(p) for p in paths]), rng.permutation(len(paths))
    raw = np.array([[x, 7] for p in paths for x in p], np.uint64).reshape(-1, 2)
    order, shared = prefixes.sorted_paths(raw, np.cumsum(length) - length, length, conv)
    want = sorted(range(len(paths)), key=lambda k: (paths[k], conv[k]))
    assert order.tolist() == want
    for a, b, d in zip(want[:-1], want[1:], shared[1:].tolist(), strict=True):
        assert paths[a][:d] == paths[b][:d] and (d in (len(paths[a]), len(paths[b])) or paths[a][d] != paths[b][d])


def test_prefix_trie_of_few_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefixes.prefix_nodes(none).collect() == []
    one = spark.createDataFrame([(40, 0, "user", "a b", "", "")], CONVERSATIONS)
    assert sorted(map(tuple, prefixes.prefix_nodes(one).collect()))[0][:2] == (40, 0) and prefixes.prefix_nodes(one).count() == 2


def collocations(rows, least=10, most=2000, inside=50):
    """Rows of the phrases of (doc_id, text, lang)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", ascii_lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i: i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def some_prose(rng, n):
    vocabulary = ["the", "of", "The", "É", "é", "a\u00a0b", "x\x1cy", "\u2028", "日本", *(f"w{k}" for k in range(12))]
    signs = [" ", " ", " ", " ", "\t", "  ", ".", ", ", "\n", " ; ", "\r", "!?"]
    return ["".join(vocabulary[min(int(rng.exponential(4)), len(vocabulary) - 1)] + signs[rng.integers(0, len(signs))] for _ in range(rng.integers(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("container, held, options", [(1 << 16, 1_500_000, {}), (8, 60, {}), (8, 60, {"most": 5}), (50, 200, {"least": 2, "inside_percent": 90})])
def test_collocations(spark, container, held, options):
    rng = np.random.default_rng(13)
    rows = [(k, t, ("en", "de", None, "en")[k % 4]) for k, t in enumerate([None, "", "...", "spam " * 3000, *some_prose(rng, 150)])]
    rows += [(7, "to be or not to be", "fr")] * 12
    got = phrases.collocations(documents(spark, rows).repartition(6), held=held, container=container, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations(rows, options.get("least", 10), options.get("most", 2000), options.get("inside_percent", 50))


def test_trie_bursts_and_spills_without_loss():
    rng = np.random.default_rng(14)
    trie, want, spilled = phrases.Trie(20), collections.Counter(), collections.Counter()
    for _ in range(30):
        ids = np.minimum(rng.exponential(6, 400).astype(np.int64), 40)
        keys = phrases.phrase_keys(ids)
        assert len(keys) == sum((ids[i: i + k] != 0).all() for k in (1, 2, 3) for i in range(len(ids) - k + 1))
        want.update(keys.tolist())
        trie.add(keys)
        assert all(len(leaf) <= 20 for leaf in trie.leaves) and len(trie.lows) == len(trie.leaves) and trie.size == sum(map(len, trie.leaves))
        if trie.size > 1500:
            for k, c in zip(*trie.spill(700), strict=True):
                spilled[int(k)] += int(c)
            assert trie.size <= 700
    for k, c in zip(*trie.spill(0), strict=True):
        spilled[int(k)] += int(c)
    assert spilled == want and trie.size == 0


def test_scores_pass_64_bits(spark):
    """A phrase of words that occur more than ten to the twelfth times."""
    f = 3 * 10**12 + 1
    assert spark.sql(f"SELECT (cast(1000000 as decimal(7, 0)) * cast({f - 2} as decimal(15, 0)) * cast({f - 2} as decimal(15, 0))) div (cast({f} as decimal(18, 0)) * cast({f + 5} as decimal(18, 0))) AS s").first().s == 1_000_000 * (f - 2) ** 2 // (f * (f + 5))


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(documents(spark, [(1, "x", "en")]).filter("false")).collect() == []


def test_components_of_a_long_chain(spark):
    """Many rounds: sizes of the rounds are those of their files, not products of estimates."""
    rng = np.random.default_rng(16)
    name = (rng.permutation(10_001) + 1).tolist()
    links = spark.createDataFrame([(name[k], name[k + 1]) for k in range(10_000)] + [(20_000, 20_001)], "u long, v long")
    got = {r.u: r.v for r in neardup.components(links).collect()}
    assert got == {k: 1 for k in range(2, 10_002)} | {20_001: 20_000}


def test_repeated_ids_keep_their_own_texts(spark):
    said, other = (" ".join(f"{k}{x}" for x in range(40)) for k in "su")
    docs = spark.createDataFrame([(1, said), (2, said), (2, other), (None, other), (None, said), (3, f"x {other}")], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in spans.remove_repeats(docs, keep_text=True).collect()]
    # by id, null ids last: the text of 1 stays, the second row of 2 is the first with its text, 3 keeps what is its own
    assert sorted(got, key=str) == sorted([(1, 40, 0, said), (2, 40, 40, ""), (2, 40, 0, other), (None, 40, 40, ""), (None, 40, 40, ""), (3, 41, 40, "x")], key=str)


def test_long_words_with_equal_sums_are_different(spark):
    """Thue-Morse words: two letters in an order whose weighted sums modulo a power of two are those of its complement."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in order) for flip in (0, 1))
    shared = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{a} {shared}"), (2, f"{b} {shared}"), (3, f"{a} {shared}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in spans.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_mix_is_the_same_however_rows_are_dealt(spark):
    rows = [(i % 300 if i % 7 else None, "w " * (1 + i * 37 % 90), f"s{i % 3}") for i in range(700)] + [(5, "a b", "s1")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = [sorted(((r.doc_id, r["size"], r.source, r.taken) for r in mixing.mix(docs.repartition(n)).collect()), key=str) for n in (1, 3, 17)]
    assert len(said[0]) == len(rows) and said[0] == said[1] == said[2]


def test_signs_are_no_letters(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(40)] + [(i, f"le chat est noir {i}", "fr") for i in range(40, 80)]
    rows += [(k, t, None) for k, t in enumerate(["½ ½", "² Ⅷ ㊀", "12 !?", "ª", "日本"], 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, F.col("doc_id") >= 100).collect()}
    assert all(got[k] == ("und", 0.0) for k in (100, 101, 102)) and all(got[k][0] in ("en", "fr") for k in (103, 104))


def test_scores_that_need_not_fit_64_bits_take_no_part(spark):
    rows = [(0, [1e30, 0.0]), (100, [2.0**20, 1.0]), (1, [2.0**20, -1.0]), (2, [3.0, 4.0]), (3, [2.0**22, 0.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 1, 2**60 - 2**20), (100, 2, 2, 2**30 * 3 * 1024 + 4 * 2**20)]
