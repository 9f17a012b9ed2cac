"""Near-duplicates, chunk dedup and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import chunkdedup, neardup, suffixdedup
from sparkloom.llm.hashing import Fingerprints, content_hashes, digests, mix64
from sparkloom.llm.words import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, extra int, n int, component_id string, `key` string"
ODD = [None, "", "  \n\t ", "one", "One", "two words", "a b c", "é ÉÉ x y z w", "x" * 5000, "la " * 3000]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 1, 2, "c", "k") for i, t in enumerate(texts)], SCHEMA).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, percent=80):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label))]


def near_corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    texts = list(ODD)
    for _ in range(5):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 90))]
        texts.append(" ".join(base))
        texts.append(" ".join(base).upper())
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randrange(1, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append("\n".join(copy))
    # Many documents that share a passage but are not alike: crowded buckets.
    texts += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(25)]) for _ in range(40)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,n", [(1, 4), (2, 5)])
def test_near_duplicates_equal_all_pairs(spark, seed, n):
    texts = near_corpus(seed)
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, texts), shingle=n).collect())
    assert got == components(texts, n)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Few bands of one row make every bucket crowded; the prefix filter alone must find all links."""
    monkeypatch.setattr(neardup, "CROWD", 1)
    texts = near_corpus(3)
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, texts), shingle=4, bands=60, rows=2).collect())
    assert got == components(texts, 4)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, None), (7, "q r s t u"), (None, "z z z z")], "doc_id long, text string")
    got = neardup.near_duplicates(df, shingle=4).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        [(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (7, 7, True), (None, None, True)]
    )
    left = neardup.one_of_each(df, shingle=4).collect()
    assert Counter(tuple(r) for r in left) == Counter([(5, "a b c d e"), (7, "q r s t u"), (None, "z z z z"), (None, None)])


def test_ids_do_not_stand_for_texts(spark):
    """Rows that share an id keep apart; rows without one are linked like others."""
    rnd = random.Random(12)

    def words_(n):
        return ["w%d" % rnd.randrange(10_000) for _ in range(n)]

    a, b, c = words_(60), words_(60), words_(60)
    near = lambda w: " ".join(w[:-1] + ["end%d" % rnd.randrange(99)])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, " ".join(c)), (None, near(c)), (None, near(c)), (4, "own words only here"), (4, "own words only here"), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, True): 3, (4, 4, True): 2, (9, 9, True): 1}
    left = Counter((r.doc_id, r.text[:30]) for r in neardup.one_of_each(df).collect())
    assert left[1, " ".join(a)[:30]] == left[1, " ".join(b)[:30]] == left[4, "own words only here"] == left[9, " "] == 1
    assert left[None, " ".join(c)[:30]] == 1 and sum(left.values()) == 5


def test_hot_shingles_are_dealt_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 1)
    monkeypatch.setattr(neardup, "CELL", 3)
    texts = near_corpus(5)
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, texts), shingle=4, bands=60, rows=2).collect())
    assert got == components(texts, 4)


def test_one_of_each_keeps_columns(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "other words are here now"])
    left = neardup.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 2]


@pytest.mark.parametrize("function", [neardup.near_duplicates, neardup.one_of_each, chunkdedup.dedup_chunks, suffixdedup.remove_repeats])
def test_empty_table(spark, function):
    assert function(frame(spark, ["x"]).where("false")).count() == 0


def test_superminhash_estimates_jaccard():
    rnd = np.random.default_rng(4)
    for size, shared in ((40, 30), (400, 200), (3, 2), (5000, 4000)):
        pool = rnd.integers(0, 1 << 63, 2 * size - shared).astype(np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
        sig = neardup.superminhash([a, b, np.zeros(0, np.uint64)], 240)
        truth = shared / (2 * size - shared)
        assert abs((sig[0] == sig[1]).mean() - truth) < 0.13
        assert (sig[2] == np.iinfo(np.uint64).max).all()


def test_superminhash_bins_get_ranks_along_a_permutation():
    """A single element fills bin by bin, each step once."""
    sig = neardup.superminhash([np.array([12345], np.uint64)], 240)[0]
    assert sorted((sig >> np.uint64(32)).tolist()) == list(range(240))


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d", "", "a  b\tc d e", "É b"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    together = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, 3)
    for t, s in zip(raw, together):
        alone = shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3)[0]
        assert s.tolist() == alone.tolist()
    assert [len(s) for s in together] == [2, 0, 3, 1]


def removed(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for k, r in enumerate(raw):
        mark = np.zeros(len(r) + 1, int)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                mark[i] += 1
                mark[i + width] -= 1
        gone = np.cumsum(mark)[:-1] > 0 if len(r) else np.zeros(0, bool)
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((k, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def byte_corpus(seed):
    rnd = random.Random(seed)

    def noise(n):
        return "".join(rnd.choice("abcdefg é\n") for _ in range(n))

    shared = [noise(rnd.randrange(60, 300)) for _ in range(4)]
    texts = [None, "", "short", "z" * 900, "ab" * 300, "ab" * 299 + "c", noise(199), "é" * 150]
    for _ in range(25):
        texts.append(noise(rnd.randrange(50)) + rnd.choice(shared) + noise(rnd.randrange(120)) + rnd.choice(shared)[rnd.randrange(40) :] + noise(rnd.randrange(30)))
    texts += [texts[-1], texts[-2], texts[-2]]
    return texts


@pytest.mark.parametrize("seed,width,hot", [(1, 100, 5000), (2, 200, 5000), (3, 100, 1)])
def test_repeats_equal_counting_all_windows(spark, monkeypatch, seed, width, hot):
    monkeypatch.setattr(suffixdedup, "HOT_PHRASES", hot)
    texts = byte_corpus(seed)
    got = suffixdedup.remove_repeats(frame(spark, texts), width=width, with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == removed(texts, width)


def test_window_classes_equal_a_dictionary():
    rnd = random.Random(8)
    entries = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
    bounds, repeated = suffixdedup.window_classes(entries, 12)
    places = defaultdict(list)
    for e, start in zip(entries, bounds):
        for i in range(len(e) - 11):
            places[e[i : i + 12]].append(start + i)
    assert set(np.flatnonzero(repeated)) == {p for at in places.values() if len(at) > 1 for p in at}


def test_chunks_resist_insertions():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abcdefghij klmno") for _ in range(4000))
    other = text[:1000] + b"something new" + text[1000:]

    def cut(t):
        s = chunkdedup.chunk_starts(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist()
        return [t[a:b] for a, b in zip(s, s[1:] + [len(t)])]

    a, b = cut(text), cut(other)
    assert b"".join(a) == text and max(map(len, a + b)) <= chunkdedup.MOST
    assert len(set(a) - set(b)) <= 3 and 15 < len(text) / len(a) < 80


def test_chunks_do_not_depend_on_neighbours():
    rnd = random.Random(6)
    raw = [bytes(rnd.choice(b"abcd ef") for _ in range(n)) for n in (0, 300, 5, 0, 1000, 20)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    together = chunkdedup.chunk_starts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    alone = [o + s for o, r in zip(offsets, raw) for s in chunkdedup.chunk_starts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))]
    assert together.tolist() == alone


def test_chunk_dedup_finds_planted_passages(spark):
    rnd = random.Random(11)

    def prose(n):
        return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n))

    passage = prose(60)
    texts = [*ODD[:5], prose(200), f"{prose(80)} {passage} {prose(50)}", f"{prose(11)}\n{passage}\n{prose(120)}", prose(150), prose(90) + passage, passage]
    texts += [texts[5]]
    got = {r.doc_id: r for r in chunkdedup.dedup_chunks(frame(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert {k for k, r in got.items() if r.n_repeated} == {5, 6, 7, 9, 10, 11}
    assert {k for k, r in got.items() if r.n_removed} == {7, 9, 10, 11}
    assert got[11].n_removed == got[11].n_bytes and got[5].n_removed == 0
    for r in got.values():
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert all(0 <= a.start < a.end <= r.n_bytes for a in r.repeated)


@pytest.mark.parametrize("unit", ["x", "to ", "and ", "threen. ", "the same line again\n", "a longer line of text that is said over and over, number 7; " * 2])
def test_periodic_passages_are_found_at_any_offset(spark, unit):
    rnd = random.Random(14)
    passage = (unit * 400)[: max(400, 5 * len(unit))]

    def prose(n):
        return "".join(rnd.choice("etaoin shrdlu") for _ in range(n))

    texts = [prose(n) + passage + prose(90) for n in (0, 1, 37, 106, 211, 300, 333)]
    got = {r.doc_id: r for r in chunkdedup.dedup_chunks(frame(spark, texts)).collect()}
    lost = chunkdedup.WINDOW + 2 * (chunkdedup.FAR + len(unit))
    assert all(r.n_repeated >= len(passage) - lost for r in got.values()), {k: r.n_repeated for k, r in got.items()}
    assert got[0].n_removed < got[0].n_bytes and all(got[k].n_removed >= len(passage) - lost for k in got if k)


def test_chunks_do_not_see_the_text_before():
    """A candidate at a text's end does not compete with the first ones of the next text."""
    rnd = random.Random(15)
    raw = [bytes(rnd.choice(b"abcd ef") for _ in range(60)) for _ in range(3000)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    together = chunkdedup.chunk_starts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    alone = [o + s for o, r in zip(offsets, raw) for s in chunkdedup.chunk_starts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))]
    assert together.tolist() == alone


def test_long_texts_by_pieces():
    """A long text handled piece by piece gives what it gives at once."""
    rnd = random.Random(12)
    raw = bytes(rnd.choice(b"abcdefg hij\n") for _ in range(9000)) + b"x" * 3000 + b" word" * 900
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    whole = shingle_sets(data, offsets, 4)[0]
    assert shingle_sets(data, offsets, 4, 500)[0].tolist() == whole.tolist()
    assert chunkdedup.chunk_starts(data, offsets, 700).tolist() == chunkdedup.chunk_starts(data, offsets).tolist()
    windows = []
    for piece in (800, 1 << 20):
        p = suffixdedup.parse(data, offsets, 200, piece)
        windows.append({w: k for lo, hi, k in zip(p["lo"].tolist(), p["hi"].tolist(), p["k"].tolist()) for w in range(lo, hi + 1)})
    assert windows[0] == windows[1] and len(windows[0]) == len(raw) - 199


def test_very_long_documents(spark):
    rnd = random.Random(13)
    base = " ".join("w%d" % rnd.randrange(5000) for _ in range(900_000))
    texts = [base, "z" * 200 + base + " end", "short text of a few words"]
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(frame(spark, texts)).collect()}
    assert (got[0].n_removed, got[1].n_removed, got[2].n_removed) == (len(base), len(base), 0)
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert near == {0: 0, 1: 0, 2: 2}
    chunks = {r.doc_id: r for r in chunkdedup.dedup_chunks(frame(spark, texts)).collect()}
    assert chunks[0].n_repeated > len(base) - 600 and chunks[2].n_repeated == 0


# Equality of content


def thue_morse(n, one, two):
    return bytes(one if bin(i).count("1") % 2 else two for i in range(n))


def test_words_that_defeat_polynomial_hashes_differ():
    a, b = thue_morse(1024, 97, 98), thue_morse(1024, 98, 97)
    data = np.frombuffer(a + b" " + b, np.uint8)
    assert Fingerprints(data)(np.array([0]), np.array([1024])) == Fingerprints(data)(np.array([1025]), np.array([2049]))
    for longest in (256, 4096):
        x = content_hashes(data, np.array([0, 1025]), np.array([1024, 2049]), longest=longest)
        assert x[0] != x[1]
    both = np.frombuffer(a + b, np.uint8)
    assert not np.array_equal(*shingle_sets(both, np.array([0, 1024, 2048]), 4))
    d = digests(both, np.array([0, 1024]), np.array([1024, 2048]))
    assert d[0].tolist() != d[1].tolist()


def test_content_hashes_depend_on_content_and_length_only():
    rnd = random.Random(3)
    raw = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(0, 40))) for _ in range(3000)] + [b"z" * 300, b"z" * 301, b"z" * 300]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    got = content_hashes(data, end - [len(r) for r in raw], end)
    by = defaultdict(set)
    for r, h in zip(raw, got.tolist()):
        by[r].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)


def test_thue_morse_documents(spark):
    a, b = thue_morse(1024, 97, 98).decode(), thue_morse(1024, 98, 97).decode()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, [a, b, a])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    # Equal but for one stretch, whose two forms collide under such hashes.
    texts = [f"{a} {'q' * 300} {b}", f"{b} {'q' * 300} {a}"]
    removed = {r.doc_id: r.n_removed for r in suffixdedup.remove_repeats(frame(spark, texts), width=1100).collect()}
    assert removed == dict(enumerate(brute_removed(texts, 1100)))


def brute_removed(texts, width):
    where = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    return [len({k for i in range(len(t) - width + 1) if where[t[i : i + width]] > 1 for k in range(i, i + width)}) for t in texts]


# Chunks


def plain_chunks(raw):
    """Chunks of one text by the definition, byte after byte."""
    gear, c, n = [int(x) for x in chunkdedup._GEAR], chunkdedup, len(raw)
    rank = []
    for i in range(n):
        h = sum(gear[raw[i - k]] << k for k in range(c.WINDOW) if k <= i) % (1 << c.WINDOW)
        r = int(mix64(np.array([h], np.uint64))[0]) >> 34
        rank.append((r + (0 if h >> (c.WINDOW - c.MASK_BITS) == 0 else 1 << 30)) if i >= c.WINDOW - 1 else 0xFFFFFFFF)
    starts = {0}
    for i, r in enumerate(rank):
        near, far = rank[max(0, i - c.RADIUS) : i + c.RADIUS + 1], rank[max(0, i - c.FAR) : i + c.FAR + 1]
        if r != 0xFFFFFFFF and ((r < 1 << 30 and r == min(near)) or r == min(far)):
            starts.add(i + 1)
    out, cuts = [], sorted(s for s in starts if s < n) + [n]
    for a, b in zip(cuts, cuts[1:]):
        out += [(x, min(b, x + c.MOST)) for x in range(a, b, c.MOST)]
    return out if n else []


def plain_runs(chunks, n, run_bytes):
    out = []
    for a, b in chunks:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(r) for r in out if r[1] - r[0] >= run_bytes or (r[0] == 0 and r[1] == n)]


@pytest.mark.parametrize("run_bytes", [0, 128])
def test_chunk_dedup_equals_plain_counting(spark, run_bytes):
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(20, 600))) for _ in range(8)]
    texts = [None, "", "x", "short copy", "short copy", "ab" * 300, "z" * 700, "z" * 600]
    for _ in range(40):
        texts.append("".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("ijklmn é") for _ in range(rnd.randrange(0, 300)))]) for _ in range(rnd.randrange(1, 6))))
    raw = [(t or "").encode() for t in texts]
    cut = [plain_chunks(r) for r in raw]
    places = defaultdict(list)
    for i, (r, c) in enumerate(zip(raw, cut)):
        for a, b in c:
            places[r[a:b]].append((i, a))
    want = []
    for i, (r, c) in enumerate(zip(raw, cut)):
        many = [(a, b) for a, b in c if len(places[r[a:b]]) > 1]
        later = [(a, b) for a, b in many if min(places[r[a:b]]) != (i, a)]
        want.append((i, len(r), plain_runs(many, len(r), run_bytes), plain_runs(later, len(r), run_bytes)))
    got = chunkdedup.dedup_chunks(frame(spark, texts), run_bytes=run_bytes).collect()
    assert sorted((r.doc_id, r.n_bytes, [tuple(x) for x in r.repeated], [tuple(x) for x in r.removed]) for r in got) == want
    assert all(r.n_repeated == sum(b - a for a, b in r.repeated) and r.n_removed == sum(b - a for a, b in r.removed) for r in got)


def test_null_and_repeated_ids_of_passages(spark):
    rnd = random.Random(4)
    a, b = ("".join(rnd.choice("abcdefghijkl ") for _ in range(900)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b[:400]), (2, "other"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "c", "k") for i, t in rows], SCHEMA)
    chunks = Counter((r.doc_id, r.n_bytes, r.n_repeated > 0) for r in chunkdedup.dedup_chunks(df).collect())
    assert chunks == {(1, 900, True): 3, (None, 900, True): 1, (None, 400, True): 1, (2, 5, False): 1, (None, 0, False): 1}
    cut = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(df, width=200).collect())
    assert cut == {(1, 900, 900): 2, (1, 900, 400): 1, (None, 900, 900): 1, (None, 400, 400): 1, (2, 5, 0): 1, (None, 0, 0): 1}


def test_a_key_with_very_many_phrases(spark, monkeypatch):
    """One passage within ever other surroundings: all its phrases share keys, few windows repeat beyond it."""
    rnd = random.Random(6)
    core = "".join(rnd.choice("abcdefghijklmnop") for _ in range(180))

    def other(n):
        return "".join(rnd.choice("qrstuvwxyz") for _ in range(n))

    texts = [other(150) + core + other(150) for _ in range(60)]
    texts += [texts[0][100:], texts[1][:400], other(5) + texts[2][120:380] + other(5)]
    want = brute_removed(texts, 200)
    for hot in (5_000, 8):
        monkeypatch.setattr(suffixdedup, "HOT_PHRASES", hot)
        got = {r.doc_id: r.n_removed for r in suffixdedup.remove_repeats(frame(spark, texts), width=200).collect()}
        assert [got[i] for i in range(len(texts))] == want
