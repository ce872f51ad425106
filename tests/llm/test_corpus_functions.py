"""The operators' local parts against plain definitions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from careweave.llm import cdc, chosen_path, gam, mixing, ogg, packing, ppm, rules, sstable, suffix, tokens

R = random.Random(5)


def prose(n, words=("the", "of", "onth", "hand", "ed", "été", "ing.", "thore,", "wh")):
    return " ".join(R.choice(words) for _ in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    e = tokens.Encoder(public_tokenizers.path(name), most=50)
    lib = Tokenizer.from_file(public_tokenizers.path(name))  # as it comes
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "'s", ".", ",", "é", "é", "\xa0", "\t", "\x1c", "12", "_", "<|endoftext|>", "日本", "don't", "Σ", " \n"]
    parts += ["\0", "\x1f", "<|startoftext|>", "Straße", "ÿ!"]
    texts = ["", prose(400)] + ["".join(R.choice(parts) for _ in range(R.randint(0, 12))) for _ in range(1500)]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    long = prose(3000)  # cut and put together again
    assert e.encode([long, "x"], most=500)[0] == e.encode([long])[0]


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip_and_checks():
    for n in (0, 1, 255, 300):
        data = R.randbytes(n)
        assert ogg.page_checksum(data) == slow_crc(data)
    for n in (0, 1, 575, 576, 577, 60_000, 200_000):
        data = R.randbytes(n)
        x = ogg.from_ogg(ogg.to_ogg(data))
        assert x["payload"][:n] == data and set(x["payload"][n:]) <= {255} and x["n_bytes"] == n
        assert x["streams"] == 2 and len(x["payload"]) % 576 == 0 and x["seconds"] == len(x["payload"]) / 8000
    packets = [R.randbytes(n) for n in (10, 0, 255, 70_000, 510, 1)]
    pages = ogg.stream_pages(packets, [0, 1, 2, 3, 4, 5], 9)
    assert ogg.demultiplex(b"".join(pages))[9]["packets"] == packets and len(pages) > 2
    media = bytearray(ogg.to_ogg(b"abc" * 999))
    media[len(media) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.from_ogg(bytes(media))
    with pytest.raises(ValueError):
        ogg.from_ogg(ogg.to_ogg(b"abc")[:-5])


def test_packing_plan_places_everything():
    for make in (lambda: R.randint(1, 2048), lambda: 2048, lambda: R.choice([700, 701, 1300, 5]), lambda: int(R.lognormvariate(5, 1)) % 2048 + 1):
        counts = Counter(make() for _ in range(700))
        lines, got = packing.plan(counts), Counter()
        for n, content in lines:
            assert n > 0 and sum(content) <= 2048
            for x in content:
                got[x] += n
        assert got == counts
        assert sum(n for n, _ in lines) <= 1.15 * sum(a * b for a, b in counts.items()) / 2048 + 60 or 1300 in counts
    assert packing.plan({}) == [] and packing.plan({1024: 2, 1023: 1, 1: 1}) == [(1, (1024, 1024)), (1, (1023, 1))]


def test_mixing_targets_and_flow():
    sizes = {"a": 100, "b": 1000, None: 10, "c": 1000}
    goal = mixing.targets(sizes)
    assert goal["a"] == 300 and abs(sum(goal.values()) - 2110) < 1e-6  # a is full, the rest goes on by weight
    assert abs(goal["b"] / goal["c"] - 2) < 1e-9 and goal[None] == 30
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}
    # a document of two sources serves the one that needs it
    flow = mixing.route({"x": (("a",), 100), "xy": (("a", "b"), 100), "y": (("b",), 50)}, {"a": 100, "b": 150})
    assert flow["x", "a"] + flow["xy", "a"] == 100 and flow["xy", "b"] + flow["y", "b"] == 150
    assert flow["x", "a"] == 100 and flow["xy", "b"] == 100 and flow["y", "b"] == 50  # nothing is repeated in vain


def slow_bits(texts, train, alphabet=256):
    """PPM with escape method D by its definition."""
    counts = {}
    for t in train:
        padded = b"\0" * 3 + t
        for i in range(3, len(padded)):
            for k in range(4):
                counts.setdefault((k, padded[i - k : i]), Counter())[padded[i]] += 1
    seen = {b for t in train for b in t}

    def p(context, b):
        if len(context) < 0:
            return 1 / alphabet
        c = counts.get((len(context), context))
        lower = p(context[1:], b) if context else 1 / alphabet
        if not c:
            return lower
        n = sum(c.values())
        return (2 * c[b] - 1) / (2 * n) if c[b] else len(c) / (2 * n) * lower

    assert seen
    return [-sum(np.log2(p((b"\0" * 3 + t)[i : i + 3], t[i])) for i in range(len(t))) for t in texts]


def test_ppm_code_lengths_are_exact():
    train = {"x": [b"the hand of the\0 land"], "y": [b"der hund und der", b"und"]}
    counts = {}
    for lang, texts in train.items():
        g, n = np.unique(np.concatenate([ppm._grams(np.frombuffer(t, np.uint8)) for t in texts]), return_counts=True)
        counts[lang] = (g.astype(np.int64), n)
    model = ppm.Model(counts)
    texts = [b"the dog", b"und der", b"", b"h", b"land hund of"]
    got = model.score(texts)
    for k, lang in enumerate(model.langs):
        want = slow_bits(texts, train[lang])
        known = [all(model.symbol[b] < model.classes - 1 for b in t) for t in texts]
        for g, w, ok in zip(got[:, k], want, known, strict=True):
            assert not ok or abs(g - w) < 1e-3


def test_gam_learns_tables_and_pairs():
    g = np.random.default_rng(1)
    x = g.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but a pair explains it
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95 and (0, 1) in model.pairs
    bins = model.binned(x[:1])
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins[0], strict=True)) + sum(t[i[bins[0, a]], j[bins[0, b]]] for (a, b), (i, j, t) in model.pairs.items())
    assert abs(model.score(x[:1])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert gam.fit(np.zeros((0, len(gam.FEATURES))), np.zeros(0)).score(np.zeros((1, len(gam.FEATURES))))[0] == 0.5
    assert len(gam.features(b"")) == len(gam.FEATURES) == len(gam.features("é! A\n\n1".encode()))


def test_rules_base_counts():
    for _ in range(60):
        text = "".join(R.choice(["a ", "b ", "é", "\n", "#", "x y z ", "\x1c", "\t"]) for _ in range(R.randint(0, 120)))
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(covered))
        assert rules.base_counts(text.encode(), text.encode().split()) == want
    d = rules.distance(np.array([[1.0, 0], [0.5, 0.5]]), np.array([[0, 1.0], [0.5, 0.5]]))
    assert d[0, 0] == 1 and d[1, 1] == 0 and 0 < d[0, 1] < 1


def test_gear_hash_and_cuts():
    data = R.randbytes(5000)
    h, table = 0, cdc.gear()
    slow = []
    for b in data:
        h = (h << 1) + int(table[b]) & 0xFFFFFFFF
        slow.append(h)
    assert cdc.rolling(data).tolist() == slow
    ends = cdc.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= 256 and sizes[:-1].min() >= 32 and cdc.cuts(b"") == [] and cdc.cuts(b"a") == [1]
    moved = {data[i:j] for i, j in cdc._chunks(data)} & {x[i:j] for x in [b"inserted" + data] for i, j in cdc._chunks(x)}
    assert len(moved) > 0.9 * len(ends)  # an insertion changes the chunks about it only
    text = "ä" * 40
    assert cdc.runs([(1, 60)], text.encode(), 10) == [(2, 60)] and cdc.runs([(0, 80)], text.encode(), 999) == [(0, 80)]


def test_chosen_path_parts():
    assert [len(chosen_path.shingles(x)) for x in (b"", b" ", b"a", b"a b c", b"a b c d e f")] == [0, 0, 1, 1, 2]
    assert (chosen_path.word_hashes(b"xx yy") == chosen_path.word_hashes(b"\nxx\tyy "))[:].all()
    sets = [np.array(sorted(R.sample(range(30), R.randint(1, 25))), np.uint64) for _ in range(40)]
    near = chosen_path.similar(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert near[i, j] == (len(x & y) / len(x | y) >= 0.8)
    found = 0
    for _ in range(200):  # pairs right at the threshold meet in some run
        common = g = np.random.default_rng(R.randint(0, 1 << 30)).integers(0, 1 << 63, 180).astype(np.uint64)
        x, y = np.concatenate([g[:160], g[160:170]]), np.concatenate([common[:160], g[170:180]])
        nodes = [chosen_path._start(chosen_path.runs_for(0.995, 0.8, 0.75, 3))] * 2
        for _ in range(3):
            nodes = [chosen_path.descend(n, s) for n, s in zip(nodes, (x, y), strict=True)]
        found += len(np.intersect1d(*nodes)) > 0
    assert found >= 194


@pytest.mark.parametrize("length", [272, 400])
def test_suffix_sorting_of_a_block(length):
    for _ in range(4):
        base = R.randbytes(900)
        copies = []
        for _ in range(6):
            a = bytearray(base[R.randint(0, 50) :])
            for _ in range(R.randint(0, 2)):
                a[R.randrange(len(a))] ^= 1
            copies.append(bytes(R.randbytes(R.randint(0, 40)) + a))
        units = []
        for t in copies:
            for a, z, p, h in suffix.pieces(t, None, length)[0]:
                units.append((h, t[a : z + length - 1], p - a, 1))
        everything = Counter(u[1][i : i + length] for u in units for i in range(len(u[1]) - length + 1))
        for u, flags in zip(units, suffix.sort_block(units, length), strict=True):
            assert flags.tolist() == [everything[u[1][i : i + length]] > 1 for i in range(len(u[1]) - length + 1)]
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_shard_file(tmp_path):
    rows = [(None, [1]), (-5, [7, 8]), (-5, []), (3, list(range(3000))), (70_000, [49_407]), (1 << 60, [5])]
    rows = sorted(rows, key=lambda r: sstable.sort_key(r[0])) + [((1 << 60) + k, [k] * 500) for k in range(1, 300)]
    path = str(tmp_path / "x.sst")
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for key, ids in rows:
            w.add(key, np.array(ids, np.uint32))
        w.finish()
    r = sstable.open_shard(path)
    assert [(k, v.tolist()) for k, v in r.rows()] == rows and len(r.blocks) > 2 and r.n_docs == len(rows)
    assert [v.tolist() for v in r.lookup(-5)] == [[7, 8], []] and r.lookup(4) == [] and r.lookup((1 << 60) + 250)[0].tolist() == [250] * 500
    assert sum(r.may_hold(k) for k in range(10_000, 11_000)) < 60
    data = bytearray(open(path, "rb").read())
    data[50] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(sstable.open_shard(path).rows())
    assert zlib.crc32(b"") == 0
